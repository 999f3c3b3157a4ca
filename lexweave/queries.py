"""

Most work on rows of keyed, markup-bearing text that one SQL text makes of ``orders`` in either engine.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import markup as M
from lexweave.functions.particles import polish
from lexweave.operators import catalog as C
from lexweave.operators import inventory as I
from lexweave.operators import translate as T
from lexweave.plans import commands
from lexweave.sources import files, sinks
from lexweave.storage import fresh_path, mounted, stored

#: Keyed rows: most in the namespace, some colours, identifiers, references and blanks among them.
ROWS = """
select o_orderkey as k,
  case when o_orderkey % 5 = 0 then 'cw_' else 'iv2_' end || 'ord_' || cast(o_custkey % 40 as string) || '_' || cast(o_orderkey % 97 as string)
    || case when o_orderkey % 31 = 3 then '_color' else '_t' end as key,
  'main_menu/localization/english/' || cast(o_orderkey % 4 as string) || '_l_english.yml' as file,
  case when o_orderkey % 2 = 0 then 'main_menu' else 'in_game' end as layer,
  cast(o_orderkey as int) as line,
  case when o_orderkey % 29 = 0 then '  '
    when o_orderkey % 23 = 0 then '$REF_' || cast(o_orderkey % 3 as string) || '$'
    when o_orderkey % 19 = 0 then 'iv2_ident'
    else 'Order $O_' || cast(o_orderkey % 7 as string) || '$ is ' || o_orderpriority || ' #bold ' || cast(o_custkey % 50 as string)
      || ' £gold£#! lot ' || chr(cast(97 + o_custkey % 26 as int)) || chr(cast(97 + o_orderkey % 7 as int)) || chr(92) || 'n [Who.GetName] @star! end' end as value
from {orders}"""
#: A translation of each row, damaged in some.
PAIRS = f"""
select *, case when k % 13 = 0 then '' when k % 17 = 0 then value || ' ⟦N1⟧' when k % 11 = 0 then replace(value, '#!', '')
  when k % 3 = 0 then value else replace(value, 'Order', '주문') end as translation from ({ROWS}) r"""

def renamed(rows: str, when: str) -> str:
    """All rows, some under another key: sides of a comparison differ by that and leave no row out."""
    return f"select k, case when {when} then key || '_else' else key end as key, file, layer, line, value from ({rows}) n"


#: Two versions of all rows: some have another key and text in either, and some another text in the new one.
OLD = f"select k, key, file, layer, line, case when k % 10 = 0 then value || ' before' else value end as value from ({renamed(ROWS, 'k % 10 = 0')}) o"
NEW = f"""select k, key, file, layer, line, case when k % 10 = 1 then value || ' after' when k % 20 = 2 then replace(value, 'Order', 'Purchase') else value end as value
  from ({renamed(ROWS, 'k % 10 = 1')}) w"""
#: Texts in Korean with particle pairs, for the operators that have no SQL.
PARTICLES = "select o_orderkey as k, decode(unhex(hex(44032 + o_custkey % 11172)), 'UTF-16BE') || '을(를) ' || cast(o_orderkey % 10 as string) || '은(는) 서울으로(로) abc이(가) ⟦T1⟧와(과) 책을(를)이(가)' as v from {orders}"

_BLANK = r"regexp_full_match({0}, '[\s\x{{85}}\p{{Z}}\v]*')"


def _tokens(v: str) -> str:
    return f"regexp_extract_all({v}, '{M.TOKEN}')"


def _blank(v: str) -> str:
    return _BLANK.format(v)


def _class(v: str) -> str:
    return f"case when {_blank(v)} then 'empty' when regexp_matches(regexp_replace({v}, '{M.TOKEN}', '', 'g'), '\\p{{L}}') then 'prose' else 'reference' end"


def _skeleton(v: str) -> str:
    return f"regexp_replace(regexp_replace({v}, '{M.TOKEN}', '{M.TOKEN_MARK}', 'g'), '[0-9]+', '{M.NUMBER_MARK}', 'g')"


def _template(s: str) -> str:
    marks = f"[{M.TOKEN_MARK}{M.NUMBER_MARK}]"
    found, between = f"regexp_extract_all({s}, '{marks}')", f"regexp_split_to_array({s}, '{marks}')"
    kind = f"case when x = '{M.TOKEN_MARK}' then 'T' else 'N' end"
    label = f"'⟦' || {kind} || len(list_filter({found}[1:i], lambda y: y = x)) || '⟧' || {between}[i + 1]"
    return f"{between}[1] || coalesce(list_aggregate(list_transform({found}, lambda x, i: {label}), 'string_agg', ''), '')"


def _template_of(v: str) -> str:
    """The template straight from a text, without a skeleton."""
    either = f"{M.TOKEN}|[0-9]+"
    found, between = f"regexp_extract_all({v}, '{either}')", f"regexp_split_to_array({v}, '{either}')"
    kind = "case when {0}[1] between '0' and '9' then 'N' else 'T' end"
    same = f"len(list_filter({found}[1:i], lambda y: {kind.format('y')} = {kind.format('x')}))"
    label = f"'⟦' || {kind.format('x')} || {same} || '⟧' || {between}[i + 1]"
    return f"{between}[1] || coalesce(list_aggregate(list_transform({found}, lambda x, i: {label}), 'string_agg', ''), '')"


def _surplus(a: str, b: str) -> str:
    n = f"(len(list_filter({a}, lambda y: y = t)) - len(list_filter({b}, lambda y: y = t)))"
    shown = f"t || case when {n} > 1 then ' x' || {n} else '' end"
    return f"coalesce(list_aggregate(list_transform(list_filter(list_sort(list_distinct({a})), lambda t: {n} > 0), lambda t: {shown}), 'string_agg', ', '), '')"


def _difference(a: str, b: str) -> str:
    lost, gained = _surplus(_tokens(a), _tokens(b)), _surplus(_tokens(b), _tokens(a))
    return f"concat_ws(', ', case when {lost} <> '' then 'lost ' || {lost} end, case when {gained} <> '' then 'gained ' || {gained} end)"


def _namespaced(k: str) -> str:
    return f"regexp_matches({k}, '(?i)(^|_)(iv2|iv_2|idea_variation_2)(_|$)')"


def _keep(k: str, v: str) -> str:
    return f"(ends_with({k}, '_color') or (regexp_full_match({v}, '[A-Za-z][A-Za-z0-9_]*') and {_namespaced(v)}))"


def _sql(text: str) -> str:
    return text.replace("{orders}", "orders")


_ROWS, _PAIRS, _OLD, _NEW = map(_sql, (ROWS, PAIRS, OLD, NEW))


def _groups(rows: str) -> str:
    return f"select {_template('s')} template, c as class, rep, members from (select {_skeleton('value')} s, min({_class('value')}) c, min(key) rep, count(*) members from ({rows}) e group by 1) g"


#: The catalog of the old rows' groups: a third is untranslated, and some translations equal their source.
CATALOG = "select template, case when length(template) % 3 = 0 then '' when length(template) % 5 = 1 then template else 'K ' || template end as korean, rep, class, cast(members as bigint) as members, cast(row_number() over (order by class, rep, template) - 1 as bigint) as pos from "
_CATALOG = f"{CATALOG}({_groups(_OLD)}) q"
#: Rules of a pair, as (rule, condition on key, value, translation).
_BROKEN = [
    ("leaked-placeholder", f"len(regexp_extract_all(translation, '{M.PLACE}')) > 0"),
    ("empty-translation", f"not {_blank('value')} and {_blank('translation')}"),
    ("token-mismatch", f"{_difference('value', 'translation')} <> ''"),
    ("do-not-translate", f"{_keep('key', 'value')} and translation <> value"),
]
_RULES = " union all ".join(f"select k, '{rule}' as rule from ({_PAIRS}) p where {when}" for rule, when in _BROKEN)

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has one."""

    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table; one that lies in fewer splits than there are cores is dealt out, as its work is in the expressions."""
    found = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return found if found.rdd.getNumPartitions() >= cores else found.repartition(cores)


def made(spark: SparkSession, sf: str, text: str = ROWS) -> DataFrame:
    return spark.sql(text, orders=table(spark, sf, "orders"))


def old_catalog(spark: SparkSession, sf: str) -> DataFrame:
    # a catalog is a file: what reads it more than once doesn't group the rows anew
    return stored(spark.sql(CATALOG + "{g} q", g=I.groups(made(spark, sf, OLD))))


#: Rows of a file of the fixture below.
FILE_ROWS = 2000
_PATH = f"replace(file, '_l_english', '_' || (k // {FILE_ROWS}) || '_l_english')"


def contents(spark: SparkSession, sf: str) -> DataFrame:
    """(path, content): the rows as files of a bounded size, with comments and versions."""
    path = F.replace("file", F.lit("_l_english"), F.concat(F.lit("_"), F.expr(f"cast(k div {FILE_ROWS} as string)"), F.lit("_l_english")))
    text = F.concat(F.lit(" "), F.col("key"), F.lit(":"), F.when(F.col("k") % 2 == 0, F.lit("1")).otherwise(""), F.lit(' "'), M.quote(F.col("value")), F.lit('" # note "x"\r'))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("line", text.alias("text")))), lambda x: x["text"])
    whole = F.concat(F.lit("﻿l_english:\n"), F.array_join(lines, "\n"), F.lit("\nbad line\n"))
    return made(spark, sf).groupBy(path.alias("path")).agg(whole.cast("binary").alias("content"))


# 2.1 sources


@query(f"select {_PATH} as path, true as had_bom, count(*) + 2 as lines from ({_ROWS}) r group by 1")
def o03_lines(spark, sf):
    return files.lines(contents(spark, sf)).groupBy("path").agg(F.bool_and("had_bom").alias("had_bom"), F.count(F.lit(1)).alias("lines"))


@query(
    f"""select key, value, {_PATH} as file, 'main_menu' as layer, cast(row_number() over (partition by {_PATH} order by line) + 1 as int) as line,
    case when k % 2 = 0 then 1 else -1 end as version, false as malformed, false as "replace" from ({_ROWS}) r"""
)
def o09_parse(spark, sf):
    return files.entries(files.parsed(files.lines(contents(spark, sf))))


@query(
    f"""select {_PATH} as path, 'main_menu' as layer, 'english' as language, true as had_bom, count(*) as keys,
    'line ' || (count(*) + 2) || ': no key separator: "bad line"' as errors from ({_ROWS}) r group by 1"""
)
def o05_file_facts(spark, sf):
    facts = files.file_facts(files.parsed(files.lines(contents(spark, sf))))
    return facts.withColumn("errors", F.array_join("errors", "; "))


@query(f"select k, split_part(file, '/', 1) as layer, contains(file, '/replace/') as \"replace\" from ({_ROWS}) r")
def o10_layer(spark, sf):
    return made(spark, sf).select("k", M.layer_of(F.col("file")).alias("layer"), M.in_replace(F.col("file")).alias("replace"))


@query(f"select layer, key from ({_ROWS}) r where k % 3 <> 0 union all select '', key from ({_ROWS}) r where k % 3 = 0")
def o12_digest(spark, sf):
    rows = made(spark, sf).select(F.when(F.col("k") % 3 == 0, F.col("key")).otherwise(F.concat("layer", F.lit("\t"), "key")).alias("value"))
    notes = spark.createDataFrame([("# layer\tkey",), ("",)], "value string")
    return files.digest_rows(rows.unionByName(notes))


def written_tree(spark: SparkSession, sf: str) -> str:
    """Writes the rows as a tree of localization files in the shared folder; its path."""
    out = mounted(fresh_path(spark))
    version = F.when(F.col("k") % 2 == 0, 1).otherwise(-1)
    sinks.write_localization(made(spark, sf).select("key", version.alias("version"), F.col("value").alias("text"), "file", "layer", "line"), out)
    return out


_TREE = f"select *, layer || '/localization/korean/0_' || (k % 4) || '_l_korean.yml' as path from ({_ROWS}) r"


@query(
    f"""select key, value, path as file, layer, cast(row_number() over (partition by path order by file, line) + 1 as int) as line, case when k % 2 = 0 then 1 else -1 end as version from ({_TREE}) t"""
)
def o01_o16_o17_written_tree(spark, sf):
    rows, _ = files.scan(spark, written_tree(spark, sf), "korean")
    return rows.select("key", "value", "file", "layer", "line", "version")


@query(f"select path, layer, 'korean' as language, true as had_bom, count(*) as keys from ({_TREE}) t group by all")
def o02_o05_tree_facts(spark, sf):
    return files.scan(spark, written_tree(spark, sf), "korean")[1].drop("errors")


_CUT = "case when k % 11 = 0 then rtrim(value) else value end"


@query(f"select k, key, {_CUT} as value, k % 11 = 0 as malformed, contains(path, '/replace/') as \"replace\" from (select *, case when k % 6 = 0 then 'a/replace/b.yml' when k % 6 = 1 then 'replace/b.yml' else file end path from ({_ROWS}) r) q")
def o08_o11_recovered_rows(spark, sf):
    k = F.col("k")
    path = F.when(k % 6 == 0, "a/replace/b.yml").when(k % 6 == 1, "replace/b.yml").otherwise(F.col("file"))
    text = F.concat(F.lit(" "), F.col("key"), F.lit(': "'), M.quote(F.col("value")), F.when(k % 11 == 0, "").otherwise('" # note'))
    rows = made(spark, sf).select(path.alias("path"), F.lit(False).alias("had_bom"), F.col("k").cast("int").alias("line"), text.alias("text"))
    return files.entries(files.parsed(rows)).select(F.col("line").cast("long").alias("k"), "key", "value", "malformed", "replace")


_FAULTS = ["no key separator", "empty key", "value is not quoted"]


@query(f"select k, case k % 4 when 0 then '{_FAULTS[0]}' when 1 then '{_FAULTS[1]}' when 2 then '{_FAULTS[2]}' end as error, k % 4 = 3 as ok from ({_ROWS}) r")
def o06_row_errors(spark, sf):
    k, key = F.col("k"), F.col("key")
    text = F.when(k % 4 == 0, key).when(k % 4 == 1, ' :0 "x"').when(k % 4 == 2, F.concat(key, F.lit(": bare"))).otherwise(F.concat(key, F.lit(': "x\\"y" # z')))
    rows = made(spark, sf).select(F.lit("p").alias("path"), F.lit(False).alias("had_bom"), k.alias("line"), text.alias("text"))
    return files.parsed(rows).select(F.col("line").alias("k"), "r.error", ((F.col("r.kind") == "row") & (F.col("r.value") == 'x"y')).alias("ok"))


@query(f"select template, korean, rep, class, members, pos from ({_CATALOG}) c")
def o13_o18_catalog_file(spark, sf):
    path = mounted(fresh_path(spark))
    sinks.write_catalog(old_catalog(spark, sf), path)
    return files.read_catalog(spark, path)


@query("select n_name as term, 'r' || n_nationkey as rendering from nation")
def o14_glossary(spark, sf):
    path = mounted(fresh_path(spark))
    terms = {r["n_name"]: f"r{r['n_nationkey']}" for r in table(spark, sf, "nation").collect()}
    sinks.write_json({"_comment": "names", "terms": terms}, path)
    return files.read_glossary(spark, path)


@query(f"select distinct layer, key from ({_ROWS}) r")
def o19_digest_file(spark, sf):
    path = mounted(fresh_path(spark))
    sinks.write_digest(I.distinct_keys(made(spark, sf)), path, ["a", "b"])
    return files.read_digest(spark, path)


@query("select 'm/' || n_nationkey || '_l_german.yml' as path from nation where n_nationkey % 2 = 1")
def o46_misnamed(spark, sf):
    root = mounted(fresh_path(spark))
    os.makedirs(f"{root}/m")
    for r in table(spark, sf, "nation").collect():
        language = "german" if r["n_nationkey"] % 2 else "korean"
        with open(f"{root}/m/{r['n_nationkey']}_l_{language}.yml", "w", encoding="utf-8") as f:
            f.write(f"l_{language}:\n")
    return files.misnamed(spark, root, "korean")


# 2.2 sinks


@query(f"""select k, replace(value || '"', '"', '\\"') as quoted from ({_ROWS}) r""")
def o15_quote(spark, sf):
    return made(spark, sf).select("k", M.quote(F.concat("value", F.lit('"'))).alias("quoted"))


@query(f"""select k, layer || '/localization/korean/0_' || (k % 4) || '_l_korean.yml' as path, ' ' || key || ':' || case when k % 2 = 0 then '1' else '' end || ' "' || value || '"' as row from ({_ROWS}) r""")
def o16_writer_rows(spark, sf):
    version = F.when(F.col("k") % 2 == 0, 1).otherwise(-1)
    return made(spark, sf).select("k", sinks.output_path(F.col("file"), F.col("layer"), "english", "korean").alias("path"), sinks.line_of(F.col("key"), version, F.col("value")).alias("row"))


@query(f"select template, class, rep, members from ({_groups(_OLD)}) g")
def o20_json_report(spark, sf):
    path = mounted(fresh_path(spark))
    sinks.write_json({"groups": [r.asDict() for r in I.groups(made(spark, sf, OLD)).toLocalIterator()]}, path)
    rows = spark.read.option("multiLine", True).schema("groups array<struct<template:string,class:string,rep:string,members:long>>").json(path)
    return rows.select(F.inline("groups"))


@query("select r_name as name, 'id' || r_regionkey as id, 'Localization' as tag, 'thumbnail.png' as picture, 'base' as needs, true as had_bom, 512 as width from region")
def o21_descriptor(spark, sf):
    rows = []
    for r in table(spark, sf, "region").collect():
        out = mounted(fresh_path(spark))
        sinks.write_metadata(out, r["r_name"], f"id{r['r_regionkey']}", "1", "2", needs=("base", "Base", "2.*"))
        sinks.write_thumbnail(out)
        with open(f"{out}/.metadata/metadata.json", "rb") as f:
            data = f.read()
        about = json.loads(data.decode("utf-8-sig"))
        with open(f"{out}/.metadata/{about['picture']}", "rb") as f:
            width = int.from_bytes(f.read(24)[16:20], "big")
        rows.append((about["name"], about["id"], about["tags"][0], about["picture"], about["relationships"][0]["id"], data.startswith(b"\xef\xbb\xbf"), width))
    return spark.createDataFrame(rows, "name string, id string, tag string, picture string, needs string, had_bom boolean, width int")


_CELLS = "select n_nationkey, n_nationkey::varchar as a, case when length(n_name) > 6 then left(n_name, 5) || '…' else n_name end as b from nation"


@query(
    f"""select 0::bigint as line, rpad('n_nationkey', greatest(11, (select max(length(a)) from ({_CELLS})))::int, ' ') || '  n_name' as text
    union all select row_number() over (order by n_nationkey), rpad(a, greatest(11, (select max(length(a)) from ({_CELLS})))::int, ' ') || '  ' || b from ({_CELLS}) c"""
)
def o22_o40_console_table(spark, sf):
    text = sinks.table_text(table(spark, sf, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey"), 1000, 6)
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line long, text string")


# 2.3 scalar functions


@query(f"select k, array_to_string({_tokens('value')}, ' ') as tokens from ({_ROWS}) r")
def o23_tokens(spark, sf):
    return made(spark, sf).select("k", F.array_join(M.tokens(F.col("value")), " ").alias("tokens"))


_KIND = "case when t = '\\n' then 'newline' when t = '#!' then 'format_end' when t[1] = '$' then 'variable' when t[1] = '[' then 'scope' when t[1] = '£' then 'icon' when t[1] = '@' then 'texticon' else 'format' end"


@query(f"select t as token, {_KIND} as kind, count(*) as n from (select unnest({_tokens('value')}) t from ({_ROWS}) r) group by all")
def o24_kinds(spark, sf):
    each = made(spark, sf).select(F.explode(M.tokens(F.col("value"))).alias("token"))
    return each.groupBy("token").agg(F.count(F.lit(1)).alias("n")).select("token", M.token_kind(F.col("token")).alias("kind"), "n")


@query(f"select k, coalesce(list_aggregate(list_sort(list_transform(list_distinct({_tokens('value')}), lambda t: t || '=' || len(list_filter({_tokens('value')}, lambda y: y = t)))), 'string_agg', ' '), '') as counts from ({_ROWS}) r")
def o25_token_counts(spark, sf):
    counts = F.transform(F.map_entries(M.token_counts(F.col("value"))), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return made(spark, sf).select("k", F.array_join(F.array_sort(counts), " ").alias("counts"))


@query(f"select count(distinct list_sort({_tokens('value')})) as signatures from ({_ROWS}) r")
def o26_signature(spark, sf):
    return made(spark, sf).agg(F.countDistinct(M.signature(F.col("value"))).alias("signatures"))


@query(f"select k, {_difference('value', 'translation')} as difference from ({_PAIRS}) p")
def o27_o39_token_difference(spark, sf):
    return made(spark, sf, PAIRS).select("k", M.describe_difference(F.col("value"), F.col("translation")).alias("difference"))


@query(f"select doc_id, regexp_replace(text, '{M.TOKEN}', '', 'g') as stripped, {_class('text')} as class from documents")
def o28_o29_strip_classify(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", M.strip_tokens(t).alias("stripped"), M.classify(t).alias("class"))


@query(f"select k, {_template('s')} as template from (select k, {_skeleton('value')} s from ({_ROWS}) r) q")
def o30_templatize(spark, sf):
    return made(spark, sf).select("k", M.templatize(F.col("value"))["template"].alias("template"))


MARKED = "select k, key, case when k % 3 = 0 then replace(value, ' lot ', '\ue000') when k % 3 = 1 then replace(value, ' lot ', ' \ue002\ue003 \ue001') else value end as value from ({0}) r"
_MARKED = MARKED.format(_ROWS)


@query(f"select t as template, count(*) as members, min(key) as rep from (select key, {_template_of('value')} t from ({_MARKED}) m) q group by 1")
def o30_o62_private_characters(spark, sf):
    """Texts that hold the characters which stand for tokens and numbers in a skeleton."""
    return I.groups(spark.sql(MARKED.format(ROWS), orders=table(spark, sf, "orders"))).select("template", "members", "rep")


@query(f"select k, value, true as ok from ({_ROWS}) r")
def o31_detemplatize(spark, sf):
    t = M.templatize(F.col("value"))
    back = made(spark, sf).select("k", t.alias("t")).select("k", M.detemplatize(F.col("t.template"), F.col("t.tokens"), F.col("t.numbers")).alias("b"))
    return back.select("k", "b.value", "b.ok")


@query(f"select k, array_to_string(regexp_extract_all(translation, '{M.PLACE}'), ' ') as found from ({_PAIRS}) p")
def o32_placeholders(spark, sf):
    return made(spark, sf, PAIRS).select("k", F.array_join(M.placeholders(F.col("translation")), " ").alias("found"))


@query(f"select k, {_namespaced('key')} as namespaced, {_keep('key', 'value')} as keep from ({_ROWS}) r")
def o33_o34_namespace(spark, sf):
    return made(spark, sf).select("k", M.namespaced(F.col("key")).alias("namespaced"), M.do_not_translate(F.col("key"), F.col("value")).alias("keep"))


@query("select doc_id, octet_length(encode(text)) = length(text) as ascii from documents")
def o35_ascii(spark, sf):
    return table(spark, sf, "documents").select("doc_id", M.ascii_only(F.col("text")).alias("ascii"))


_SETTLED = """select o_orderkey as k, chr(cast(44032 + o_custkey % 11172 as int)) || case when (o_custkey % 11172) % 28 = 0 then '를 ' else '을 ' end
  || (o_orderkey % 10) || case when o_orderkey % 10 in (0, 1, 3, 6, 7, 8) then '은' else '는' end || ' 서울로 abc이(가) ⟦T1⟧와(과) 책을이' as v from orders"""


@query(_SETTLED)
def o36_o37_particles(spark, sf):
    return made(spark, sf, PARTICLES).select("k", polish(F.col("v")).alias("v"))


@query("select c_custkey, regexp_replace(c_name, '[0-9]+', '#', 'g') as shape from customer")
def o38_key_shape(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", M.key_shape(F.col("c_name")).alias("shape"))


@query("select doc_id, case when length(t) > 40 then left(t, 39) || '…' else t end as short from (select doc_id, translate(text, chr(10) || chr(13) || chr(9), '   ') t from documents) d")
def o40_shorten(spark, sf):
    return table(spark, sf, "documents").select("doc_id", M.shorten(M.one_line(F.col("text")), 40).alias("short"))


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def o41_json_answer(spark, sf):
    said = F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, sf, "events").select("event_id", M.json_answer(said)["k"].alias("k"))


# 2.4, 2.5 filters and sets


@query(f"select key, value from ({_ROWS}) r where not {_namespaced('key')}")
def o42_foreign(spark, sf):
    return I.foreign(made(spark, sf)).select("key", "value")


@query(f"select template, rep, pos from ({_CATALOG}) c where class = 'prose' and korean = '' and not {_keep('rep', 'template')}")
def o43_pending(spark, sf):
    return C.pending(old_catalog(spark, sf)).select("template", "rep", "pos")


@query(f"select count(*) as units, count(*) filter (where korean <> '') as translated from ({_CATALOG}) c")
def o44_translated(spark, sf):
    return old_catalog(spark, sf).agg(F.count(F.lit(1)).alias("units"), F.count_if(F.col("korean") != "").alias("translated"))


@query(
    """select rule, count(*) as n from (select o_orderkey k, unnest(list_filter([case when o_orderkey % 3 = 0 then 'bad-filename' end,
    case when o_orderkey % 2 = 0 then 'missing-bom' end, case when o_orderkey % 5 = 0 then 'bad-header' end], lambda x: x is not null)) rule from orders) group by 1"""
)
def o45_file_findings(spark, sf):
    k = F.col("o_orderkey")
    path = F.when(k % 3 == 0, "m/x/").otherwise("m/localization/korean/")
    rows = table(spark, sf, "orders").select(F.concat(path, k.cast("string")).alias("path"), (k % 2 != 0).alias("had_bom"), F.when(k % 5 == 0, "german").otherwise("korean").alias("language"))
    return C.file_findings(rows, "korean").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(f"select distinct layer, key from ({_OLD} union all select k, key, file, layer, line, value from ({_NEW})) u")
def o47_distinct_keys(spark, sf):
    return I.distinct_keys(made(spark, sf, OLD), made(spark, sf, NEW))


@query(f"select key, file, line, value from (select *, row_number() over (partition by key order by file, line) n from ({_ROWS}) r) q where n = 1")
def o48_first_rows(spark, sf):
    return I.first_rows(made(spark, sf).select("key", "file", "line", "value"), "key", "file", "line")


@query(
    f"""select key, file, ordinal from (select *, row_number() over (partition by key order by ordinal, file) n from (
    select key, file, 0 as ordinal from ({renamed(_OLD, 'k % 4 <> 0')}) a union all select key, file, 1 from ({_NEW}) b) u) q where n = 1"""
)
def o49_first_baseline(spark, sf):
    a = made(spark, sf, renamed(OLD, "k % 4 <> 0")).select("key", "file", F.lit(0).alias("ordinal"))
    return I.first_rows(a.unionByName(made(spark, sf, NEW).select("key", "file", F.lit(1).alias("ordinal"))), "key", "ordinal", "file")


@query(f"select key from ({_NEW}) n where key not in (select key from ({renamed(_OLD, 'k % 3 = 0')}) o)")
def o50_added_keys(spark, sf):
    return C.added_keys(made(spark, sf, NEW), made(spark, sf, renamed(OLD, "k % 3 = 0")))


@query(f"select distinct key from ({_NEW}) n where key in (select key from ({renamed(_OLD, 'k % 3 <> 0')}) o)")
def o51_shadowed(spark, sf):
    return C.shadowed(made(spark, sf, NEW), made(spark, sf, renamed(OLD, "k % 3 <> 0")))


@query(f"select count(distinct value) as texts, (select count(distinct t) from (select unnest({_tokens('value')}) t from ({_ROWS}) a)) as tokens from ({_ROWS}) r")
def o52_distinct(spark, sf):
    rows = made(spark, sf)
    tokens = I.token_usage(rows).agg(F.sum("texts").alias("tokens")).withColumn("_one", F.lit(1))
    return rows.agg(F.countDistinct("value").alias("texts")).withColumn("_one", F.lit(1)).join(tokens, "_one").drop("_one")


# 2.6 joins


def _bound(rows: str) -> str:
    return f"""select key, arg_max(template, (-n, template)) template from (select key, t template, count(*) over (partition by t) n
      from (select key, {_template('s')} t from (select key, {_skeleton('value')} s from ({rows}) a) b) c) d group by key"""


@query(_bound(_ROWS))
def o53_bind(spark, sf):
    return C.bind(made(spark, sf)).select("key", "template")


@query(f"select g.template, g.members, coalesce(c.korean, '') as korean from ({_groups(_NEW)}) g left join ({_CATALOG}) c using (template)")
def o54_template_join(spark, sf):
    known = C.last_units(old_catalog(spark, sf)).select("template", "korean")
    return I.groups(made(spark, sf, NEW)).join(known, "template", "left").select("template", "members", F.coalesce("korean", F.lit("")).alias("korean"))


@query(f"select b.batch, n_name as term, 'r' || n_nationkey as rendering from nation join (select doc_id % 10 as batch, text from documents) b on contains(lower(b.text), lower(left(n_name, 3))) group by all")
def o60_glossary_terms(spark, sf):
    nations = table(spark, sf, "nation").select(F.left("n_name", F.lit(3)).alias("term"), F.concat(F.col("n_name"), F.lit("/r"), F.col("n_nationkey").cast("string")).alias("rendering"))
    got = C.relevant_terms(table(spark, sf, "documents").select((F.col("doc_id") % 10).alias("batch"), "text"), nations)
    both = F.split("rendering", "/")
    return got.select("batch", both[0].alias("term"), both[1].alias("rendering"))


# 2.7 aggregations


@query(_groups(_ROWS))
def o62_groups(spark, sf):
    return I.groups(made(spark, sf))


@query(_groups("select doc_id as key, text as value from documents where text is not null"))
def o62_groups_documents(spark, sf):
    return I.groups(table(spark, sf, "documents"), "doc_id", "text")


@query(_groups("select event_id as key, props as value from events where props is not null"))
def o62_groups_events(spark, sf):
    return I.groups(table(spark, sf, "events"), "event_id", "props")


@query(_groups("select page_id as key, html as value from pages where html is not null"))
def o62_groups_pages(spark, sf):
    return I.groups(table(spark, sf, "pages"), "page_id", "html")


_BY_CLASS = ", ".join(f"count(*) filter (where c = '{c}') as {c}_keys" for c in I.CLASSES)
_BY_GROUP = ", ".join(f"count(*) filter (where class = '{c}') as {c}_groups" for c in I.CLASSES)


@query(
    f"""select * from (select count(*) as keys, count(distinct value) as "values", {_BY_CLASS}, 0::bigint as malformed from (select *, {_class('value')} c from ({_ROWS}) r) a),
    (select count(*) as groups, {_BY_GROUP}, coalesce(sum(length(template)) filter (where class = 'prose'), 0)::bigint as prose_chars from ({_groups(_ROWS)}) g)"""
)
def o63_summary(spark, sf):
    rows = made(spark, sf)
    return I.summary(rows, I.groups(rows))


@query(f"select key, string_agg(file || ':' || line, ' ' order by file, line) as places from ({_ROWS}) r group by key having count(*) > 1")
def o64_duplicates(spark, sf):
    return I.duplicates(made(spark, sf)).select("key", F.array_join("places", " ").alias("places"))


@query(f"select array_to_string(string_split(key, '_')[1:3], '_') as prefix, count(*) as n from ({_ROWS}) r group by 1")
def o65_prefixes(spark, sf):
    return I.prefixes(made(spark, sf))


@query(f"select regexp_replace(key, '[0-9]+', '#', 'g') as shape, count(*) as n, min(key) as example from ({_ROWS}) r where not {_namespaced('key')} group by 1")
def o66_foreign_shapes(spark, sf):
    return I.foreign_shapes(made(spark, sf))


@query(f"select kind, count(t) as n, count(distinct t) as texts from (select unnest({list(M.KINDS)}) kind) a left join (select t, {_KIND} kind from (select unnest({_tokens('value')}) t from ({_ROWS}) r)) b using (kind) group by 1")
def o67_token_usage(spark, sf):
    return I.token_usage(made(spark, sf))


def _findings(spark, sf):
    return made(spark, sf, PAIRS).select("k", F.explode(M.check_pair(F.col("key"), F.col("value"), F.col("translation"))).alias("h")).select("k", "h.rule")


@query(f"select rule, count(*) as n, 'error' as severity from ({_RULES}) r group by 1")
def o68_by_rule(spark, sf):
    return C.by_rule(_findings(spark, sf).withColumn("severity", C.severity("rule")))


@query(f"select count(*) as errors, 0::bigint as warnings from ({_RULES}) r")
def o69_severities(spark, sf):
    return C.severities(_findings(spark, sf).withColumn("severity", C.severity("rule")))


@query(f"select layer, count(*) as n from (select distinct key, first_value(layer) over (partition by key order by file, line) layer from ({renamed(_OLD, 'k % 3 <> 0')}) o where key in (select key from ({_NEW}))) q group by 1")
def o70_shadowed_by_layer(spark, sf):
    base = made(spark, sf, renamed(OLD, "k % 3 <> 0"))
    first = I.first_rows(base.select("key", "file", "line", "layer"), "key", "file", "line")
    return C.shadowed(made(spark, sf, NEW), base).join(first, "key").groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


#: Each key's last text, by its group's size and template, then by its tokens and numbers.
_LAST = f"""select key, arg_max(template, (-n, template, t, d)) template, arg_max(value, (-n, template, t, d)) bound from (select *, count(*) over (partition by template) n from
  (select key, value, {_template_of('value')} template, {_tokens('value')} t, regexp_extract_all(regexp_replace(value, '{M.TOKEN}', '{M.TOKEN_MARK}', 'g'), '[0-9]+') d from ({_ROWS}) a) b) c group by key"""
_KO = f"select e.*, {_keep('e.key', 'e.value')} keep, case when c.korean is not null and not {_keep('e.key', 'e.value')} then case when c.korean = c.template then l.bound else 'K ' || l.bound end end ko from ({_ROWS}) e left join ({_LAST}) l using (key) left join (select * from ({_CATALOG}) u where korean <> '') c using (template)"
_SOUND = f"({_difference('value', 'ko')} = '' and not (not {_blank('value')} and {_blank('ko')}))"
_RENDER = f"""select k, case when ko is not null and ko <> value and {_SOUND} then ko else value end as text, keep as do_not_touch,
  coalesce(ko <> value and {_SOUND}, false) as translated, not coalesce(ko <> value and {_SOUND}, false) as english, coalesce(ko <> value and not {_SOUND}, false) as fell_back from ({_KO}) q"""


@query(
    f"""select count(*) as keys, count(*) filter (where translated) as translated, count(*) filter (where english) as english, count(*) filter (where do_not_touch) as do_not_touch,
    count(*) filter (where fell_back) as fell_back, sum(octet_length(encode(text)))::bigint as bytes from ({_RENDER}) r"""
)
def o71_build_stats(spark, sf):
    return C.build_stats(C.render(made(spark, sf), old_catalog(spark, sf)))


@query(_RENDER)
def o87_render(spark, sf):
    return C.render(made(spark, sf), old_catalog(spark, sf)).select("k", "text", "do_not_touch", "translated", "english", "fell_back")


@query(f"select template, '' as korean, rep, class, members, row_number() over (order by class, rep, template) - 1 as pos from ({_groups(_ROWS)}) g")
def o72_o77_catalog(spark, sf):
    return C.from_groups(I.groups(made(spark, sf)))


@query("select sum(l_quantity)::bigint as tokens_in, sum(l_linenumber)::bigint as tokens_out, (sum(l_quantity)::bigint + 5 * sum(l_linenumber)::bigint) / 1e6::double as dollars from lineitem")
def o73_cost(spark, sf):
    return C.cost(table(spark, sf, "lineitem").select(F.col("l_quantity").cast("long").alias("tokens_in"), F.col("l_linenumber").cast("long").alias("tokens_out")))


@query(f"select distinct key from ({_PAIRS}) p join ({_RULES}) r using (k)")
def o74_fallback_keys(spark, sf):
    rows = made(spark, sf, PAIRS).select("key", F.explode(M.check_pair(F.col("key"), F.col("value"), F.col("translation"))).alias("h"))
    return C.fallback_keys(rows.select("key", "h.rule"))


# 2.8 order, limits, batches


@query(f"select template, members, rep from ({_groups(_ROWS)}) g where class = 'prose' order by members desc, template limit 15")
def o76_o79_top_groups(spark, sf):
    return I.top(I.groups(made(spark, sf)).where("class = 'prose'"), 15, F.desc("members"), "template").select("template", "members", "rep")


@query(f"select rule, k from (select *, row_number() over (partition by rule order by k) n from ({_RULES}) r) q where n <= 20")
def o80_top_each(spark, sf):
    return I.top_each(_findings(spark, sf), 20, "rule", "k").select("rule", "k")


@query(f"select template, pos from ({_CATALOG}) c where class = 'prose' and korean = '' and not {_keep('rep', 'template')} order by pos limit 50")
def o81_limit_pending(spark, sf):
    return C.pending(old_catalog(spark, sf), limit=50).select("template", "pos")


@query("select o_orderkey as pos, (row_number() over (order by o_orderkey) - 1) // 40 as batch, (row_number() over (order by o_orderkey) - 1) % 40 + 1 as id from orders")
def o82_batches(spark, sf):
    return I.batches(table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"))).select("pos", F.col("batch").cast("long").alias("batch"), F.col("id").cast("long").alias("id"))


@query(
    f"""select pos, template, answer, rejection from (select k as pos, value as template, translation as answer, case when {_blank('translation')} then 'empty' when k % 17 = 0 then 'added ⟦N1⟧' else '' end as rejection from ({_PAIRS}) p) q
    where rejection <> '' order by pos limit 20"""
)
def o83_rejections(spark, sf):
    done = made(spark, sf, PAIRS).select(F.col("k").alias("pos"), F.col("value").alias("template"), F.col("translation").alias("answer"), T.gate(F.col("value"), F.col("translation")).alias("rejection"))
    return T.rejections(done)


# 2.9 pipelines


@query(_RULES)
def o84_check_pair(spark, sf):
    return _findings(spark, sf)


@query(f"select k, case when k in (select k from ({_RULES}) r) then value else translation end as text from ({_PAIRS}) p")
def o85_fallback(spark, sf):
    return made(spark, sf, PAIRS).select("k", M.fallback(F.col("key"), F.col("value"), F.col("translation")).alias("text"))


_FIRST = f"(select key, layer, value from (select *, row_number() over (partition by key order by file, line) n from ({_OLD}) o) q where n = 1)"
_PACK = f"select k, key, file, case when k % 37 = 0 then 'loading_screen' else layer end as layer, line, translation as value from ({_PAIRS}) p"
_JOINED = f"select p.key, p.layer, p.value translation, s.value, s.layer sl, s.key is not null known, b.key is not null based from ({_PACK}) p left join {_FIRST} s using (key) left join (select distinct key from ({renamed(_NEW, 'k % 41 <> 0')}) n) b using (key)"
_BROKEN_HERE = " or ".join(f"({when})" for _, when in _BROKEN)
_ALL = f"""select 'unknown-key' rule from ({_JOINED}) j where not known union all select 'shadows-baseline' from ({_JOINED}) j where known and based
  union all select 'layer-mismatch' from ({_JOINED}) j where known and sl <> layer
  {' '.join(f"union all select '{rule}' from ({_JOINED}) j where known and {when}" for rule, when in _BROKEN)}
  union all select 'untranslated' from ({_JOINED}) j where known and translation = value and {_class('value')} = 'prose' and not {_keep('key', 'value')} and not ({_BROKEN_HERE})
  union all select 'duplicate-key' from ({_PACK}) p group by key having count(*) > 1"""


@query(f"select rule, count(*) as n from ({_ALL}) a group by 1")
def o55_o56_o57_o86_findings(spark, sf):
    pack = made(spark, sf, PAIRS).select("key", "file", F.when(F.col("k") % 37 == 0, "loading_screen").otherwise(F.col("layer")).alias("layer"), "line", F.col("translation").alias("value"))
    base = made(spark, sf, renamed(NEW, "k % 41 <> 0")).select("key", "file", "layer", F.lit(0).alias("ordinal"))
    found = C.findings(made(spark, sf, OLD), pack, base)
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


_FRESH = f"(select * from ({_groups(_NEW)}) g where template not in (select template from ({_CATALOG}) c))"
_ORPHANS = f"(select * from ({_CATALOG}) c where template not in (select template from ({_groups(_NEW)}) g))"
_WINS = f"(select b.template nt, arg_min(o.pos, o.pos) pos, arg_min(o.template, o.pos) pt, arg_min(o.korean, o.pos) pk from {_ORPHANS} o join ({_bound(_NEW)}) b on b.key = o.rep join {_FRESH} f on f.template = b.template group by 1)"
_CHANGES = f"""select case when c.korean = '' and g.class = 'prose' then 'untranslated' else 'unchanged' end kind, template, g.rep, g.class, g.members, '' previous_template, c.korean previous_korean
    from ({_groups(_NEW)}) g join ({_CATALOG}) c using (template)
  union all select case when w.nt is null then 'new' else 'changed' end, f.template, f.rep, f.class, f.members, coalesce(w.pt, ''), coalesce(w.pk, '') from {_FRESH} f left join {_WINS} w on w.nt = f.template
  union all select 'orphaned', template, rep, class, members, '', korean from {_ORPHANS} o where pos not in (select pos from {_WINS} w)"""


@query(_CHANGES)
def o58_o59_o88_compare(spark, sf):
    return C.compare(made(spark, sf, NEW), old_catalog(spark, sf))


@query(f"select count(*) filter (where kind in ('new', 'changed', 'untranslated')) as work from ({_CHANGES}) c")
def o75_work(spark, sf):
    return C.work(C.compare(made(spark, sf, NEW), old_catalog(spark, sf)))


@query(f"select kind, template, members, rep from ({_CHANGES}) c where kind <> 'unchanged' order by members desc, rep, kind, template limit 100")
def o78_change_order(spark, sf):
    changes = C.compare(made(spark, sf, NEW), old_catalog(spark, sf)).where("kind <> 'unchanged'")
    return I.top(changes, 100, F.desc("members"), "rep", "kind", "template").select("kind", "template", "members", "rep")


@query(
    f"""select template, coalesce(c.korean, '') as korean, g.rep, g.class, g.members, case when c.pos is null then 'added' when c.rep = g.rep and c.class = g.class and c.members = g.members then 'kept' else 'refreshed' end as state
    from ({_groups(_NEW)}) g left join ({_CATALOG}) c using (template) union all select template, korean, rep, class, members, 'orphan' from {_ORPHANS} o"""
)
def o89_merge(spark, sf):
    return C.merge(I.groups(made(spark, sf, NEW)), old_catalog(spark, sf)).drop("pos")


@query(f"select k, case when {_blank('translation')} then 'empty' when k % 17 = 0 then 'added ⟦N1⟧' else '' end as rejection from ({_PAIRS}) p")
def o91_gate(spark, sf):
    return made(spark, sf, PAIRS).select("k", T.gate(F.col("value"), F.col("translation")).alias("rejection"))


def echo(prompt: str) -> tuple[str, int, int]:
    """A client for trials: answers each item with itself."""
    body = prompt[prompt.index("{") :]
    return f"```json\n{body}\n```", len(prompt) // 4, len(body) // 4


@query(f"select template, template as korean, '' as rejection from ({_CATALOG}) c where class = 'prose' and korean = '' and not {_keep('rep', 'template')}")
def o90_translate(spark, sf):
    return T.run(C.pending(old_catalog(spark, sf)), echo).select("template", "korean", "rejection")


@query(f"select k as pos, v as polished, true as changed from ({_SETTLED}) s")
def o94_polish_catalog(spark, sf):
    rows = made(spark, sf, PARTICLES).select(F.col("k").alias("pos"), F.col("v").alias("korean"))
    return C.polish_catalog(rows).select("pos", "polished", "changed")


@query(
    """select status, case when status in (0, 408, 409, 429, 500, 529) then 4 else 1 end as calls, case when status in (0, 408, 409, 429, 500, 529) then 7.0 else 0.0 end::double as waited
    from (select unnest([0, 400, 401, 404, 408, 409, 429, 500, 529]) as status)"""
)
def o92_retries(spark, sf):
    """Calls and seconds waited for before a call is given up after three repeats, by the status of its failure; 0: none."""
    rows = []
    for status in (0, 400, 401, 404, 408, 409, 429, 500, 529):
        calls, waits = [], []

        def client(prompt, status=status, calls=calls):
            calls.append(prompt)
            raise T.CallFailed("failed", status or None)

        T.ask(client, "p", 3, lambda s, waits=waits: waits.append(float(int(s))))
        rows.append((status, len(calls), float(sum(waits))))
    return spark.createDataFrame(rows, "status int, calls int, waited double")


@query(
    """select n_regionkey, 'Glossary:' || chr(10) || (select string_agg(r_name || ' = ' || r_regionkey || chr(10), '' order by r_name) from region) || chr(10)
      || '{' || string_agg('"' || n_nationkey || '": "' || n_name || '"', ', ' order by n_nationkey) || '}' as prompt from nation group by 1"""
)
def o93_prompts(spark, sf):
    terms = {r["r_name"]: str(r["r_regionkey"]) for r in table(spark, sf, "region").collect()}
    items: dict[int, dict[int, str]] = {}
    for r in table(spark, sf, "nation").collect():
        items.setdefault(r["n_regionkey"], {})[r["n_nationkey"]] = r["n_name"]
    return spark.createDataFrame([(k, T.prompt(v, terms)) for k, v in sorted(items.items())], "n_regionkey int, prompt string")


@query(f"select template, '' as korean, rep, class, members, row_number() over (order by class, rep, template) - 1 as pos from ({_groups(_ROWS)}) g")
def o95_init_catalog(spark, sf):
    root, path = mounted(fresh_path(spark)), mounted(fresh_path(spark))
    rows = made(spark, sf).select("key", F.lit(-1).alias("version"), F.col("value").alias("text"), "file", "layer", "line")
    sinks.write_localization(rows, root, "english", "english")
    commands.main(["build", "--src", root, "--init-catalog", path], spark, say=lambda *_: None)
    return files.read_catalog(spark, path)


@query(f"select key, file, line from ({_ROWS}) r where key = (select min(key) from ({_ROWS})) order by file, line limit 1")
def o96_lookup(spark, sf):
    rows = made(spark, sf)
    return files.lookup(rows, rows.agg(F.min("key")).first()[0]).select("key", "file", "line")
