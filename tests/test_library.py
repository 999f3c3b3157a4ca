"""Laws and small trees: templates, particles, files, rules, rendering, comparison and translation."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexweave.functions import markup as M
from lexweave.functions.particles import fix_particles
from lexweave.operators import catalog as C
from lexweave.operators import inventory as I
from lexweave.operators import translate as T
from lexweave.plans import commands
from lexweave.sources import files, sinks

BOM = "﻿"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first()["x"]


def many(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


TEXT = st.text(st.sampled_from(list("ab 12$[]£@!#\\n\"⟦⟧TN;_한\n")), max_size=30)


@settings(max_examples=5, deadline=None)
@given(st.lists(TEXT, min_size=40, max_size=60))
def test_template_round_trip_and_quote_round_trip(spark, values):
    got = many(spark, values, lambda v: F.struct(M.templatize(v).alias("t"), M.unquote(F.concat(F.lit('"'), M.quote(v), F.lit('"'))).alias("q")))
    filled = spark.createDataFrame([(i, *g["t"]) for i, g in enumerate(got)], "i int, template string, tokens array<string>, numbers array<string>")
    back = filled.select("i", M.detemplatize(F.col("template"), F.col("tokens"), F.col("numbers")).alias("b")).orderBy("i").collect()
    for v, r, g in zip(values, back, got, strict=True):
        if "⟦" not in v:
            assert (r["b"]["value"], r["b"]["ok"]) == (v, True)
        if "\\" not in v:
            assert (g["q"]["value"], g["q"]["ok"]) == (v, True)


def test_templates_and_classes(spark):
    cases = {
        "Level 3": ("Level ⟦N1⟧", "prose"),
        "$A$ 1 of 2 [B.C]": ("⟦T1⟧ ⟦N1⟧ of ⟦N2⟧ ⟦T2⟧", "prose"),
        "$KEY_12$": ("⟦T1⟧", "reference"),
        "#bold x#!\\n": ("⟦T1⟧ x⟦T2⟧⟦T3⟧", "prose"),
        " 　": (" 　", "empty"),
        "12 %": ("⟦N1⟧ %", "reference"),
    }
    got = many(spark, list(cases), lambda v: F.struct(M.templatize(v)["template"], M.classify(v)))
    assert [tuple(g) for g in got] == list(cases.values())


def test_bad_placeholders_are_not_filled(spark):
    df = spark.createDataFrame([("⟦T2⟧x⟦N0⟧y⟦N99999999999⟧", ["a"], ["1"])], "t string, a array<string>, b array<string>")
    assert tuple(df.select(M.detemplatize(F.col("t"), F.col("a"), F.col("b")).alias("x")).first()["x"]) == ("xy", False)


def test_particles(spark):
    cases = {
        "책을(를)": "책을", "나무을(를)": "나무를", "서울으로(로)": "서울로", "집로(으로)": "집으로", "⟦T1⟧와(과)": "⟦T1⟧와(과)",
        "⟦T1⟧과(와)": "⟦T1⟧와(과)", "abc을(를)": "abc을(를)", "10은(는)": "10은", "2이(가)": "2가", "이(가)": "이(가)", "책을(를)이(가)": "책을이",
        "사과과(과)": "사과와", "그냥 글": "그냥 글", "7으로(로)": "7로", "": "",
    }
    assert many(spark, list(cases), fix_particles) == list(cases.values())


def test_long_values_need_no_deep_stack(spark):
    v = "x" * 200_000
    assert one(spark, f'"{v}"', M.unquote)["value"] == v


@pytest.fixture()
def tree(tmp_path):
    def write(rel, text, bom=True):
        path = tmp_path / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(((BOM if bom else "") + text).encode())
        return str(tmp_path)

    return write


SOURCE = """l_english:
 # note
 iv2_level_1:0 "Level 1" # first
 iv2_level_2: "Level 2 \\"up\\" # in"
 iv2_open: "no end
 iv2_tint_color: "green"
 iv2_ref: "$OTHER$"
bad line
 : "x"
 iv2_bare: x
"""


def source_tree(tree):
    root = tree("src/main_menu/localization/english/a_l_english.yml", SOURCE)
    tree("src/main_menu/localization/english/b_l_english.yml", 'l_english:\r\n iv2_level_1: "Level 9"\r\n cw_x_1: "Hi [Who] there"\r\n', bom=False)
    tree("src/main_menu/localization/german/c_l_german.yml", 'l_german:\n k: "v"\n')
    tree("src/.git/localization/english/d_l_english.yml", 'l_english:\n k: "v"\n')
    return f"{root}/src"


def test_scan(spark, tree):
    rows, facts = files.scan(spark, source_tree(tree), "english")
    got = {(r.key, r.file[-15:]): (r.value, r.line, r.version, r.malformed, r.layer) for r in rows.collect()}
    assert got[("iv2_level_1", "a_l_english.yml")] == ("Level 1", 3, 0, False, "main_menu")
    assert got[("iv2_level_2", "a_l_english.yml")][0] == 'Level 2 "up" # in'
    assert got[("iv2_open", "a_l_english.yml")][:4] == ("no end", 5, -1, True)
    assert len(got) == 7 and got[("cw_x_1", "b_l_english.yml")][0] == "Hi [Who] there"
    by = {r.path[-15:]: r for r in facts.collect()}
    assert by["a_l_english.yml"].had_bom and not by["b_l_english.yml"].had_bom and by["b_l_english.yml"].language == "english"
    assert by["a_l_english.yml"].errors == ['line 8: no key separator: "bad line"', 'line 9: empty key: " : "x""', 'line 10: value is not quoted: " iv2_bare: x"']
    assert [tuple(r) for r in I.duplicates(rows).select("key", F.size("places")).collect()] == [("iv2_level_1", 2)]
    assert files.lookup(rows, "iv2_level_1").first().value == "Level 1"


def catalog_of(spark, rows, korean):
    return C.from_groups(I.groups(rows)).withColumn("korean", F.coalesce(F.create_map(*(F.lit(x) for kv in korean.items() for x in kv))[F.col("template")], F.lit("")))


def test_build_validate_and_diff(spark, tree, tmp_path):
    src = source_tree(tree)
    rows, _ = files.scan(spark, src, "english")
    catalog = catalog_of(spark, rows, {"Level ⟦N1⟧": "⟦N1⟧을(를) 단계", "Hi ⟦T1⟧ there": "안녕"})
    path, out = str(tmp_path / "catalog.json"), str(tmp_path / "out")
    sinks.write_catalog(catalog, path)
    again = files.read_catalog(spark, path)
    assert sorted(map(tuple, again.select("template", "korean").collect())) == sorted(map(tuple, catalog.select("template", "korean").collect()))
    stats = commands.build(spark, src, out, again).first()
    # a text without its token falls back; a key's last definition binds all of them
    assert (stats.keys, stats.translated, stats.fell_back, stats.do_not_touch, stats.files) == (7, 2, 1, 1, 2)
    text = (tmp_path / "out/main_menu/localization/korean/0_a_l_korean.yml").read_bytes().decode()
    assert text.startswith(f'{BOM}l_korean:\n iv2_level_1:0 "9를 단계"\n iv2_level_2: "Level 2 \\"up\\" # in"\n')
    found = commands.validate(spark, src, out)["findings"]
    rules = {r.rule: r.n for r in C.by_rule(found).collect()}
    assert rules == {"malformed-source": 1, "duplicate-key": 1, "untranslated": 3}
    changes = commands.diff(spark, src, again, out)
    assert {r.kind for r in changes["changes"].collect()} <= {"unchanged", "untranslated"}
    assert changes["added_keys"].count() == changes["removed_keys"].count() == 0
    assert commands.main(["extract", "--src", src, "--json", str(tmp_path / "x.json")], spark, say=lambda *_: None) == 0
    assert json.loads((tmp_path / "x.json").read_text())["summary"][0]["keys"] == 7
    assert commands.main(["keys", "--src", src, "--out", str(tmp_path / "keys.txt")], spark, say=lambda *_: None) == 0
    digest = files.read_digest(spark, str(tmp_path / "keys.txt"))
    assert {r.key for r in digest.collect()} == {r.key for r in rows.collect()}
    assert commands.main(["nonsense"], spark) == 2 and commands.main(["validate", "--src", str(tmp_path / "none")], spark, say=lambda *_: None) == 1


def test_broken_pack(spark, tree):
    src = source_tree(tree)
    out = tree("out/main_menu/localization/korean/replace/x_l_korean.yml", 'l_english:\n iv2_new: "a"\n iv2_level_2: ""\n iv2_tint_color: "초록"\n iv2_ref: "⟦T1⟧"\n', bom=False) + "/out"
    tree("out/main_menu/localization/korean/wrong.yml", "l_korean:\n")
    tree("out/in_game/localization/korean/y_l_korean.yml", 'l_korean:\n cw_x_1: "Hi [Who] there"\n')
    base = tree("base/main_menu/localization/english/z_l_english.yml", 'l_english:\n cw_x_1: "b"\n') + "/base"
    got = commands.validate(spark, src, out, [base])
    rules = {r.rule: r.n for r in got["rules"].collect()}
    assert rules == {
        "malformed-source": 1, "missing-bom": 1, "bad-header": 1, "bad-filename": 1, "replace-dir": 4, "unknown-key": 1, "empty-translation": 1,
        "do-not-translate": 1, "leaked-placeholder": 1, "token-mismatch": 1, "shadows-baseline": 1, "layer-mismatch": 1, "untranslated": 1,
    }
    assert [r.key for r in got["fallback_keys"].orderBy("key").collect()] == ["iv2_level_2", "iv2_ref", "iv2_tint_color"]
    assert [r.key for r in got["shadowed"].collect()] == ["cw_x_1"]


def test_merge_twice_is_merge_once_and_one_orphan_is_claimed(spark):
    old = spark.createDataFrame([("iv2_a", "Alpha x"), ("iv2_b", "Beta"), ("iv2_c", "Gone")], "key string, value string")
    new = spark.createDataFrame([("iv2_a", "Alpha y"), ("iv2_b", "Beta"), ("iv2_d", "Fresh")], "key string, value string")
    catalog = C.from_groups(I.groups(old)).withColumn("korean", F.concat(F.lit("k "), "template"))
    kinds = {r.template: (r.kind, r.previous_korean) for r in C.compare(new, catalog).collect()}
    assert kinds == {"Alpha y": ("changed", "k Alpha x"), "Beta": ("unchanged", "k Beta"), "Fresh": ("new", ""), "Gone": ("orphaned", "k Gone")}
    first = C.numbered(C.merge(I.groups(new), catalog))
    second = C.numbered(C.merge(I.groups(new), first.drop("state")))
    show = lambda df: sorted(map(tuple, df.drop("state").collect()))
    assert show(first) == show(second) and first.count() == 5
    assert tuple(C.merge_stats(catalog, I.groups(new), C.merge(I.groups(new), catalog, True), True).first()) == (2, 1, 0, 2)


def test_translation_retries_and_gates(spark):
    waits, calls = [], []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise T.CallFailed("busy", 429)
        return 'ok {"1": "하나"}', 5, 6

    assert T.ask(flaky, "p", sleep=waits.append) == ({"1": "하나"}, 5, 6, "") and len(waits) == 2 and 1 <= waits[0] < 2 <= waits[1] < 3

    def refused(prompt):
        raise T.CallFailed("no", 401)

    assert T.ask(refused, "p", sleep=waits.append)[3] == "no" and len(waits) == 2
    units = spark.createDataFrame([("Get ⟦N1⟧", "", "a", "prose", 2, 0), ("Take", "", "b", "prose", 1, 1)], C.UNIT)
    done = T.run(units, lambda p: ('{"1": "얻다", "2": "책을(를)"}', 10, 20), batch=2).orderBy("pos").collect()
    assert [(r.korean, r.rejection) for r in done] == [("", "lost ⟦N1⟧"), ("책을", "")]
    assert sum(r.tokens_in for r in done) == 10


def test_stream_of_groups(spark, tmp_path):
    from lexweave.streaming.templates import running_groups, upsert_catalog

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", "Level 1"), ("b", "Level 2")], "key string, value string").write.parquet(src)
    stream = spark.readStream.schema("key string, value string").parquet(src)
    q = running_groups(stream).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("running").collect()] == [("Level ⟦N1⟧", "prose", "a", 2)]
    each = upsert_catalog(out)
    each(spark.read.parquet(src), 0)
    each(spark.createDataFrame([("c", "Level 3"), ("d", "Other")], "key string, value string"), 1)
    each(spark.createDataFrame([("c", "Level 3"), ("d", "Other")], "key string, value string"), 1)
    assert sorted(r.template for r in spark.read.parquet(f"{out}/batch=*").collect()) == ["Level ⟦N1⟧", "Other"]


def test_pictures_and_descriptor(tmp_path):
    sinks.write_metadata(str(tmp_path), "n", "i", "1", "2")
    assert (tmp_path / ".metadata/metadata.json").read_bytes().startswith(b"\xef\xbb\xbf{\n\t")
    assert sinks.write_thumbnail(str(tmp_path)) and not sinks.write_thumbnail(str(tmp_path))


def test_a_translation_like_its_source_is_english(spark):
    rows = spark.createDataFrame([("iv2_a", "Level 1"), ("iv2_b", "Other"), ("iv2_c", "Get $A$")], "key string, value string")
    catalog = catalog_of(spark, rows, {"Level ⟦N1⟧": "Level ⟦N1⟧", "Other": "다른", "Get ⟦T1⟧": "얻다"})
    got = {r.key: (r.text, r.translated, r.english, r.fell_back) for r in C.render(rows, catalog).collect()}
    assert got == {"iv2_a": ("Level 1", False, True, False), "iv2_b": ("다른", True, False, False), "iv2_c": ("Get $A$", False, True, True)}


def test_marks_of_skeletons_are_plain_characters_in_texts(spark):
    values = ["\ue000 x", "$A$ x", "\ue001", "7", "\ue002\ue003\ue002", "\ue002\ue004 5"]
    rows = spark.createDataFrame([(str(k), v) for k, v in enumerate(values)], "key string, value string")
    want = {"0": "\ue000 x", "1": "⟦T1⟧ x", "2": "\ue001", "3": "⟦N1⟧", "4": "\ue002\ue003\ue002", "5": "\ue002\ue004 ⟦N1⟧"}
    assert {r.rep: r.template for r in I.groups(rows).collect()} == want


def test_batches_keep_rows_without_a_position(spark):
    rows = spark.createDataFrame([(5,), (None,), (200_000,)], "pos long")
    assert [tuple(r) for r in I.batches(rows, 2).orderBy("batch", "id").collect()] == [(5, 0, 1), (200_000, 0, 2), (None, 1, 1)]


def test_glossaries_of_any_size_match_alike(spark):
    terms = [(f"Term{k}x", f"r{k}") for k in range(50)] + [("", "empty"), (None, "none"), ("ÄPFEL", "a"), ("äpfel", "b")]
    glossary = spark.createDataFrame(terms, "term string, rendering string")
    texts = spark.createDataFrame([(1, "a TERM7X and term12x"), (1, "term7x"), (2, "Äpfel"), (3, None)], "batch int, text string")
    want = [(1, "", "empty"), (1, "Term12x", "r12"), (1, "Term7x", "r7"), (2, "", "empty"), (2, "ÄPFEL", "a"), (2, "äpfel", "b")]
    for most in (3, 10_000):
        assert sorted(map(tuple, C.relevant_terms(texts, glossary, most=most).collect())) == want
    assert C.relevant_terms(texts, glossary.limit(0)).count() == 0


def test_commands_without_catalog_and_with_a_client(spark, tree, tmp_path):
    src, out, path = source_tree(tree), tmp_path / "pack", str(tmp_path / "catalog.json")
    quiet = lambda *_: None
    assert commands.main(["help"], spark, say=quiet) == 0
    assert commands.main(["build", "--src", src, "--out", str(out), "--id", "my_pack", "--single-file", "--no-validate"], spark, say=quiet) == 0
    text = (out / "main_menu/localization/korean/0_my_pack_l_korean.yml").read_bytes().decode()
    assert ' cw_x_1: "Hi [Who] there"\n' in text
    assert json.loads((out / ".metadata/metadata.json").read_text("utf-8-sig"))["picture"] == "thumbnail.png"
    assert commands.main(["build", "--src", src], spark, say=quiet) == 1
    assert commands.main(["build", "--src", src, "--init-catalog", path], spark, say=quiet) == 0
    units = files.read_catalog(spark, path).collect()
    assert units and all(u.korean == "" for u in units)
    assert commands.main(["translate", "--catalog", path], spark, say=quiet) == 1
    assert commands.main(["translate", "--catalog", path, "--client", "no_such_module:x"], spark, say=quiet) == 1
    assert commands.main(["translate", "--catalog", path, "--batch", "1"], spark, client=lambda prompt: ('{"1": "하나"}', 1, 2), say=quiet) == 0
    assert any(u.korean == "하나" for u in files.read_catalog(spark, path).collect())
    counts = C.change_counts(C.compare(files.scan(spark, src)[0], files.read_catalog(spark, path))).first()
    assert counts.unchanged == len(units) and 0 < counts.untranslated < counts.unchanged and counts.new == counts.orphaned == 0


@pytest.fixture()
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_file_is_read_in_splits(spark, tree, small_splits):
    rows = "".join(f' iv2_{k}: "text {k} of many 글"\n' for k in range(100))
    root = tree("m/localization/english/a_l_english.yml", "l_english:\n" + rows)
    tree("m/localization/english/b_l_english.yml", "l_english:\r\n" + rows.rstrip("\n"), bom=False)
    tree("m/localization/english/c_l_english.yml", "l_english:\n\n" + rows.rstrip("\n"))
    tree("m/localization/english/d_l_english.yml", "")
    tree("m/localization/english/e_l_english.yml", "", bom=False)
    tree("m/localization/english/f_l_english.yml", "\n")
    whole = files.lines(files.read_tree(spark, root, "*_l_english.yml"))
    parts = files.read_lines(spark, root, "*_l_english.yml")
    assert parts.rdd.getNumPartitions() > 8
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.select(parts.columns).collect()))
    # Spark lists no file without a byte
    assert {r.path[-15:-14] for r in parts.collect()} == set("abcdf")


def test_a_pack_is_written_by_tasks(spark, tmp_path, monkeypatch):
    rows = spark.range(5000).select(
        F.concat(F.lit("iv2_"), "id").alias("key"), F.lit(-1).alias("version"), F.lit('a "b"').alias("text"),
        F.concat(F.lit("x/"), (F.col("id") % 3).cast("string"), F.lit("_l_english.yml")).alias("file"), F.lit("m").alias("layer"), (5000 - F.col("id")).cast("int").alias("line"),
    )
    monkeypatch.setattr("pyspark.sql.DataFrame.toLocalIterator", None)
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toLocalIterator", None)
    assert sinks.write_localization(rows, str(tmp_path)) == 3
    for k in range(3):
        got = (tmp_path / f"m/localization/korean/0_{k}_l_korean.yml").read_bytes().decode()
        assert got == f"{BOM}l_korean:\n" + "".join(f' iv2_{i}: "a \\"b\\""\n' for i in range(4999, -1, -1) if i % 3 == k)
    assert [sinks._part(n) for n in ("part-00011-9c-1a.c000.txt", "part-100000-9c-1a-c012.txt")] == [(11, 0), (100000, 12)]


def test_a_filter_on_parsed_lines_parses_none_twice(spark):
    rows = spark.range(1).selectExpr("'p' as path", "false as had_bom", "cast(id as int) as line", "cast(id as string) as text")
    plan = files.entries(files.parsed(rows))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("instr(") == 1


def test_particles_ask_for_the_kind_without_patterns(spark):
    plan = spark.range(1).select(fix_particles(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract(" not in plan


def test_a_comparison_reads_its_rows_once(spark):
    rows = spark.range(20).selectExpr("concat('iv2_', id) as key", "concat('Text $A$ ', id % 3, ' x', chr(int(97 + id % 5))) as value")
    plan = C.compare(rows, C.from_groups(I.groups(rows)).limit(0))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 20") <= 2
    held = {r.key: r.template for r in C.bind(rows).collect()}
    assert len(held) == 20 and held["iv2_0"] == "Text ⟦T1⟧ ⟦N1⟧ xa"
