"""The commands: extract, validate, keys, build, translate, polish and diff, as functions and a command line."""

from __future__ import annotations

import argparse
import functools
import importlib
import os
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import markup as M
from lexweave.operators import catalog as C
from lexweave.operators import inventory as I
from lexweave.operators import translate as T
from lexweave.sources import files, sinks
from lexweave.storage import stored


def extract(spark: SparkSession, src: str, lang: str = "english") -> dict[str, DataFrame]:
    """Files, rows, groups and all summaries of a tree."""
    rows, facts = files.scan(spark, src, lang)
    grouped = I.groups(rows)
    return {
        "files": facts,
        "entries": rows,
        "groups": I.ordered(grouped),
        "summary": I.summary(rows, grouped),
        "tokens": I.token_usage(rows),
        "duplicates": I.duplicates(rows),
        "prefixes": I.prefixes(rows),
        "foreign": I.foreign_shapes(rows),
    }


def baseline(spark: SparkSession, trees: list[str], digests: list[str], languages: tuple[str, ...]) -> DataFrame | None:
    """(key, file, layer, ordinal) of baseline trees, in both languages, and then digests (O-49)."""
    parts, ordinal = [], 0
    for root in trees:
        for lang in languages:
            parts.append(files.scan(spark, root, lang)[0].select("key", "file", "layer", F.lit(ordinal).alias("ordinal")))
            ordinal += 1
    for path in digests:
        parts.append(files.read_digest(spark, path).select("key", F.lit("(key digest)").alias("file"), "layer", F.lit(ordinal).alias("ordinal")))
        ordinal += 1
    out = parts[0] if parts else None
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validate(spark: SparkSession, src: str, out: str | None = None, baselines: list[str] = (), digests: list[str] = (), src_lang: str = "english", dst_lang: str = "korean") -> dict[str, DataFrame]:
    """Findings of a pack, keys that shadow the baseline, and keys that must stay as they are (O-86)."""
    source, facts = files.scan(spark, src, src_lang)
    if not facts.limit(1).count():
        raise ValueError(f"no *_l_{src_lang}.yml files under {src}")
    base = baseline(spark, list(baselines), list(digests), (src_lang, dst_lang))
    got = {"keep": source.where(M.do_not_translate(F.col("key"), F.col("value"))).select("key").distinct()}
    if base is not None:
        got["shadowed"] = C.shadowed(source, base)
        first = I.first_rows(base, "key", "ordinal", "file")
        got["shadowed_by_layer"] = got["shadowed"].join(first, "key").groupBy("layer").agg(F.count(F.lit(1)).alias("n"))
    if out is None:
        return got
    pack, pack_files = files.scan(spark, out, dst_lang)
    found = C.findings(source, pack, base).unionByName(C.file_findings(pack_files, dst_lang))
    text = lambda s: F.lit(s).alias
    wrong = files.misnamed(spark, out, dst_lang).select(text("error")("severity"), text("bad-filename")("rule"), text("")("key"), F.col("path").alias("file"), F.lit(0).alias("line"), text(f"name must end in _l_{dst_lang}.yml")("message"), text("")("source"), text("")("translation"))
    found = found.unionByName(wrong)
    path = os.path.abspath(out)
    if not path.isascii():
        row = [("error", "non-ascii-path", "", path, 0, "the path has characters beyond ASCII", "", "")]
        found = found.unionByName(spark.createDataFrame(row, C.FINDING))
    return got | {"findings": found, "rules": C.by_rule(found), "fallback_keys": C.fallback_keys(found)}


def keys(spark: SparkSession, srcs: list[str], langs: tuple[str, ...] = ("english", "korean")) -> DataFrame:
    """Distinct (layer, key) of trees and languages (O-47)."""
    return I.distinct_keys(*(files.scan(spark, s, lang)[0] for s in srcs for lang in langs))


def build(spark: SparkSession, src: str, out: str, catalog: DataFrame | None, src_lang: str = "english", dst_lang: str = "korean", single: str | None = None) -> DataFrame:
    """Writes the pack and returns its statistics (O-87); without a catalog every text stays as it is."""
    if not out.isascii():
        raise ValueError("the output path has characters beyond ASCII")
    catalog = spark.createDataFrame([], C.UNIT) if catalog is None else catalog
    rendered = stored(C.render(files.scan(spark, src, src_lang)[0], catalog))
    n = sinks.write_localization(rendered, out, src_lang, dst_lang, single)
    return C.build_stats(rendered).withColumn("files", F.lit(n))


def diff(spark: SparkSession, src: str, catalog: DataFrame, out: str | None = None, lang: str = "english", dst_lang: str = "korean") -> dict[str, DataFrame]:
    """Changes since the catalog, and keys added to or gone from the source (O-88)."""
    rows, _ = files.scan(spark, src, lang)
    got = {"changes": C.compare(rows, catalog).orderBy("kind", F.desc("members"), "rep")}
    if out:
        pack, _ = files.scan(spark, out, dst_lang)
        got |= {"added_keys": C.added_keys(rows, pack).orderBy("key"), "removed_keys": C.added_keys(pack, rows).orderBy("key")}
    return got


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexweave")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: tuple) -> None:
        p = sub.add_parser(name)
        for flag, options in flags:
            p.add_argument(f"--{flag}", **options)

    text = lambda **o: {"default": "", **o}
    many, yes, number = {"action": "append", "default": []}, {"action": "store_true"}, lambda n: {"type": int, "default": n}
    sub.add_parser("help")
    command("extract", ("src", {"required": True}), ("lang", text(default="english")), ("json", text()), ("top", number(15)), ("show-foreign", yes))
    command("validate", ("src", {"required": True}), ("out", text()), ("baseline", many), ("baseline-keys", many), ("src-lang", text(default="english")), ("dst-lang", text(default="korean")), ("json", text()), ("limit", number(20)))
    command("keys", ("src", many), ("lang", many), ("out", {"required": True}))
    command("build", ("src", {"required": True}), ("out", text()), ("catalog", text()), ("init-catalog", text()), ("name", text(default="Pack")), ("id", text(default="pack")), ("version", text(default="1.0.0")), ("game-version", text(default="*")), ("single-file", yes), ("no-validate", yes), ("limit", number(10)))
    command("translate", ("catalog", {"required": True}), ("glossary", text()), ("client", text()), ("model", text()), ("batch", number(40)), ("concurrency", number(4)), ("limit", number(0)), ("retries", number(5)), ("retranslate", yes), ("dry-run", yes))
    command("polish", ("catalog", {"required": True}), ("limit", number(10)))
    command("diff", ("src", {"required": True}), ("catalog", {"required": True}), ("out", text()), ("lang", text(default="english")), ("dst-lang", text(default="korean")), ("update", yes), ("prune", yes), ("json", text()), ("limit", number(10)))
    return top


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def main(argv: list[str] | None = None, spark: SparkSession | None = None, client=None, say=print) -> int:
    """Runs a command; 2 for a wrong command line, 1 for an error or blocking findings."""
    try:
        a = arguments().parse_args(argv)
    except SystemExit as x:
        return 2 if x.code else 0
    if a.command == "help":
        say(arguments().format_help())
        return 0
    spark = spark or SparkSession.builder.appName("lexweave").getOrCreate()
    try:
        return _run(a, spark, client, say)
    except (ValueError, OSError, ImportError, AttributeError, AnalysisException) as x:
        say(f"error: {x}")
        return 1


def _run(a, spark: SparkSession, client, say) -> int:
    show = lambda title, df, n: say(f"{title}\n{sinks.table_text(df, n)}\n")
    if a.command == "extract":
        got = extract(spark, a.src, a.lang)
        got["entries"].persist()
        show("Summary", got["summary"], 1)
        show("Tokens", got["tokens"], 7)
        show("Largest groups", I.ordered(got["groups"].where("class = 'prose'")), a.top)
        show("Duplicate keys", got["duplicates"].orderBy("key"), 20)
        show("Key prefixes", I.top(got["prefixes"], 10, F.desc("n"), "prefix"), 10)
        if a.show_foreign:
            show("Foreign keys", I.top(got["foreign"], 25, F.desc("n"), "shape"), 25)
        if a.json:
            sinks.write_json({"summary": _rows(got["summary"]), "groups": _rows(I.ordered(I.groups(got["entries"])))}, a.json)
    elif a.command == "validate":
        got = validate(spark, a.src, a.out or None, a.baseline, a.baseline_keys, a.src_lang, a.dst_lang)
        if "shadowed" in got:
            show("Shadowed keys", got["shadowed"].orderBy("key"), a.limit)
        if "findings" in got:
            found = got["findings"].persist()
            show("Rules", C.by_rule(found).orderBy(F.desc("n"), "rule"), 20)
            show("Findings", I.top_each(found, a.limit, "rule", "file", "line", "key").orderBy("rule", "rank"), 10_000)
            if a.json:
                sinks.write_json({"findings": _rows(found), "fallback_keys": [r["key"] for r in got["fallback_keys"].orderBy("key").collect()]}, a.json)
            return int(C.severities(found).first()["errors"] > 0)
    elif a.command == "keys":
        sinks.write_digest(keys(spark, a.src, tuple(a.lang) or ("english", "korean")), a.out, a.src)
    elif a.command == "build":
        if a.init_catalog:
            sinks.write_catalog(C.from_groups(I.groups(files.scan(spark, a.src)[0])), a.init_catalog)
            return 0
        if not a.out or not a.id.isascii():
            raise ValueError("a build needs --out, and an id in ASCII")
        catalog = files.read_catalog(spark, a.catalog) if a.catalog else None
        stats = build(spark, a.src, a.out, catalog, single=a.id if a.single_file else None)
        sinks.write_metadata(a.out, a.name, a.id, a.version, a.game_version)
        sinks.write_thumbnail(a.out)
        show("Built", stats, 1)
        if not a.no_validate:
            return _run(arguments().parse_args(["validate", "--src", a.src, "--out", a.out]), spark, client, say)
    elif a.command == "translate":
        units = files.read_catalog(spark, a.catalog)
        todo = C.pending(units, a.retranslate, a.limit)
        if client is None and a.client:
            module, _, name = a.client.partition(":")
            client = getattr(importlib.import_module(module), name or "client")
            client = functools.partial(client, model=a.model) if a.model else client
        if a.dry_run or client is None:
            show("Pending", todo.select("pos", "template", "members"), 20)
            return 0 if a.dry_run else 1
        terms = {r["term"]: r["rendering"] for r in files.read_glossary(spark, a.glossary).collect()} if a.glossary else {}
        # answers are paid for: they are stored before anything reads them
        done = stored(T.run(todo, client, terms, a.batch, a.retries, a.concurrency))
        fresh = done.where("korean <> ''").select("pos", F.col("korean").alias("_new"))
        merged = units.join(fresh, "pos", "left").withColumn("korean", F.coalesce("_new", "korean")).drop("_new")
        sinks.write_catalog(merged, a.catalog)
        show("Cost", C.cost(done), 1)
        show("Rejected", T.rejections(done), 20)
    elif a.command == "polish":
        units = files.read_catalog(spark, a.catalog)
        fixed = C.polish_catalog(units).persist()
        show("Changed", fixed.where("changed").select("korean", "polished"), a.limit)
        merged = units.join(fixed.select("pos", "polished"), "pos", "left").withColumn("korean", F.coalesce("polished", "korean")).drop("polished")
        sinks.write_catalog(merged, a.catalog)
    elif a.command == "diff":
        units = files.read_catalog(spark, a.catalog)
        got = diff(spark, a.src, units, a.out or None, a.lang, a.dst_lang)
        show("Changes", C.change_counts(got["changes"]), 1)
        show("Work", C.work(got["changes"]), 1)
        if a.json:
            sinks.write_json({k: _rows(v) for k, v in got.items()}, a.json)
        if a.update:
            merged = C.numbered(C.merge(I.groups(files.scan(spark, a.src, a.lang)[0]), units, a.prune))
            sinks.write_catalog(merged, a.catalog)
    return 0


if __name__ == "__main__":
    sys.exit(main())
