"""Readers: trees of keyed text files, key digests, catalogs and glossaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions import markup as M

UNITS = "version int, units array<struct<template:string,korean:string,rep:string,class:string,members:long>>"
#: A line without its comment: a # inside quotes is data. Possessive, so long lines need no deep stack.
NO_COMMENT = r'\A(?:[^"#]++|"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+(?:"|\\?\z))*+'
#: Unicode's white space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trim(v: Column) -> Column:
    return F.btrim(v, F.lit(SPACE))


def lines(files: DataFrame) -> DataFrame:
    """(path, had_bom, line, text) of (path, content): byte order mark stripped, lines from 1 (O-02, O-03)."""
    bom = F.coalesce(F.substring(F.col("content"), 1, 3) == F.lit(b"\xef\xbb\xbf"), F.lit(False))
    text = F.coalesce(F.col("content").cast("string"), F.lit(""))
    whole = F.when(bom, F.substr(text, F.lit(2))).otherwise(text)
    # the content stays behind: each line would carry it through the generator
    split = files.select("path", bom.alias("had_bom"), F.split(whole, "\n", -1).alias("pieces"))
    pieces = F.col("pieces")
    kept = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)
    split = split.select("path", "had_bom", kept.alias("kept"))
    rows = split.select("path", "had_bom", F.posexplode_outer("kept").alias("at", "raw"))
    return rows.select("path", "had_bom", (F.coalesce("at", F.lit(-1)) + 1).alias("line"), F.regexp_replace(F.coalesce("raw", F.lit("")), r"\r\z", "").alias("text"))


def parsed(numbered: DataFrame) -> DataFrame:
    """Adds a struct ``r`` to lines: kind (skip, header, row, error), language, key, version, value, malformed, error (O-04 to O-09)."""

    # each step is a projection of its own, so that what later steps take more than once is computed once
    t, colon, key, rest, body, inner = (F.col(f"_{c}") for c in ("t", "colon", "key", "rest", "body", "inner"))
    rows = numbered.select("path", "had_bom", "line", "text", trim(F.regexp_extract("text", NO_COMMENT, 0)).alias("_t"))
    rows = rows.withColumn("_colon", F.instr(t, ":"))
    rows = rows.withColumns({"_key": trim(F.substr(t, F.lit(1), colon - 1)), "_rest": trim(F.substr(t, colon + 1))})
    rows = rows.withColumn("_digits", F.when(rest.startswith('"'), "").otherwise(F.regexp_extract(rest, "^[0-9]*", 0)))
    rows = rows.withColumn("_body", F.when(F.col("_digits") == "", rest).otherwise(trim(F.substr(rest, F.length("_digits") + 1))))
    # what an opening quote is followed by, up to a bare quote or a backslash at the end
    rows = rows.withColumn("_inner", F.regexp_extract(body, r'\A"([^"\\]*+(?:\\[\s\S][^"\\]*+)*+)', 1))
    closed = body.startswith('"') & (F.substr(body, F.length("_inner") + 2, F.lit(1)) == '"')
    fault = F.when(colon == 0, "no key separator").when(key == "", "empty key").when(~body.startswith('"'), "value is not quoted")
    rows = rows.withColumns({"_header": t.startswith("l_") & t.endswith(":") & t.rlike(r'^l_[^ \t"]*:\z'), "_closed": closed, "_fault": fault})
    header, fault = F.col("_header"), F.col("_fault")
    # a missing closing quote: the rest of the line is the value
    whole = F.col("_closed") | (F.length("_body") == F.length("_inner") + 1)
    r = F.struct(
        F.when(t == "", "skip").when(header, "header").when(fault.isNotNull(), "error").otherwise("row").alias("kind"),
        F.when(header, F.regexp_extract(t, "^l_(.*):$", 1)).alias("language"),
        key.alias("key"),
        F.coalesce(F.col("_digits").try_cast("int"), F.lit(-1)).alias("version"),
        F.when(whole, F.replace(inner, F.lit('\\"'), F.lit('"'))).otherwise("").alias("value"),
        (~F.col("_closed")).alias("malformed"),
        fault.alias("error"),
    )
    # a generator, as a filter on what it gives stays above it; pushed below, it would parse each line again
    return rows.select("path", "had_bom", "line", "text", F.explode(F.array(r)).alias("r"))


def entries(rows: DataFrame) -> DataFrame:
    """(key, value, file, layer, line, version, malformed, replace) of parsed lines (O-06 to O-11)."""
    path = F.col("path")
    return rows.where("r.kind = 'row'").select(
        "r.key", "r.value", path.alias("file"), M.layer_of(path).alias("layer"), "line", "r.version", "r.malformed", M.in_replace(path).alias("replace")
    )


def file_facts(rows: DataFrame) -> DataFrame:
    """(path, layer, language, had_bom, keys, errors) of parsed lines; the last header counts (O-05, O-09)."""
    said = F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), F.col("r.error"), F.lit(': "'), F.col("text"), F.lit('"'))
    errors = F.array_sort(F.collect_list(F.when(F.col("r.kind") == "error", F.struct("line", said.alias("said")))))
    facts = rows.groupBy("path").agg(
        F.coalesce(F.max_by("r.language", F.when(F.col("r.kind") == "header", F.col("line"))), F.lit("")).alias("language"),
        F.bool_or("had_bom").alias("had_bom"),
        F.count_if(F.col("r.kind") == "row").alias("keys"),
        errors.alias("e"),
    )
    return facts.select("path", M.layer_of(F.col("path")).alias("layer"), "language", "had_bom", "keys", F.col("e.said").alias("errors"))


def _relative(path: Column, root: str) -> Column:
    base = root.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    return F.regexp_replace(path, rf"^.*?\Q{base}\E/+", "")


_HIDDEN = r"(^|/)\.(git|metadata)/"


def read_tree(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, content, length) of a tree's files, paths relative to it; .git and .metadata folders are left out.

    Spark's listing also skips names that start with _ or a dot.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return found.select(_relative(F.col("path"), root).alias("path"), "content", "length").where(~F.col("path").rlike(_HIDDEN))


def read_lines(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """What ``lines`` gives of a tree's files, read in splits: a file of any size is never one row.

    A line's number is its place in its split, shifted by the lines of the file's splits before it. Spark's
    reader strips the byte order mark; the bytes that its lines leave unexplained tell of it.
    """
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", "\n").text(root)
    split = [F.col(f"_metadata.file_{c}").alias(f"_{c}") for c in ("path", "block_start", "block_length")]
    raw = found.select(*split, F.col("_metadata.file_size").alias("_size"), "value", F.monotonically_increasing_id().alias("_id"))
    of = [f"_{c}" for c in ("path", "block_start", "block_length")]
    counts = raw.groupBy(*of).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"), F.max("_id").alias("_last"), F.sum(F.octet_length("value") + 1).alias("_bytes"), F.max("_size").alias("_size")
    )
    whole = Window.partitionBy("_path")
    before = F.sum("_n").over(whole.orderBy("_block_start")) - F.col("_n")
    # 3 bytes are the mark, one less where the last line has no end
    bom = F.col("_size") - F.sum("_bytes").over(whole) >= 2
    splits = counts.select(*of, (before - F.col("_first") + 1).alias("_shift"), "_first", "_last", bom.alias("had_bom"))
    rows = raw.drop("_size").join(F.broadcast(splits), of, "left")
    # both reads must have been cut alike
    number = F.when(F.col("_id").between(F.col("_first"), F.col("_last")), F.col("_id") + F.col("_shift")).otherwise(F.raise_error(F.lit("a tree changed while it was read")).cast("long"))
    numbered = rows.select("_path", "had_bom", number.cast("int").alias("line"), F.regexp_replace("value", r"\r\z", "").alias("text"))
    numbered = numbered.select(_relative(F.col("_path"), root).alias("path"), "had_bom", "line", "text").where(~F.col("path").rlike(_HIDDEN))
    known = splits.select(_relative(F.col("_path"), root).alias("path")).distinct()
    bare = read_tree(spark, root, pattern).select("path", "length").where("length <= 3").join(known, "path", "left_anti")
    return numbered.unionByName(bare.select("path", (F.col("length") == 3).alias("had_bom"), F.lit(0).alias("line"), F.lit("").alias("text")))


def scan(spark: SparkSession, root: str, language: str = "english") -> tuple[DataFrame, DataFrame]:
    """(entries, files) of a tree's ``*_l_<language>.yml`` files (O-01)."""
    rows = parsed(read_lines(spark, root, f"*_l_{language}.yml"))
    return entries(rows), file_facts(rows)


def misnamed(spark: SparkSession, root: str, language: str) -> DataFrame:
    """(path) of .yml files that lack the language's suffix (O-46)."""
    return read_tree(spark, root, "*.yml").select("path").where(~F.col("path").endswith(f"_l_{language}.yml"))


def lookup(found: DataFrame, key: str) -> DataFrame:
    """The first entry of a key (O-96)."""
    return found.where(F.col("key") == key).orderBy("file", "line").limit(1)


def digest_rows(text: DataFrame) -> DataFrame:
    """(layer, key) of digest lines in ``value``; comments and blank lines are skipped (O-12)."""
    row = F.regexp_replace("value", r"\r+\z", "")
    both = F.split(row, "\t", 2)
    alone = F.size(both) == 1
    kept = text.where(~trim(F.col("value")).startswith("#") & ~M.blank(F.col("value")))
    return kept.select(F.when(alone, "").otherwise(both[0]).alias("layer"), F.when(alone, trim(row)).otherwise(F.get(both, F.lit(1))).alias("key"))


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    return digest_rows(spark.read.option("lineSep", "\n").text(path))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(template, korean, rep, class, members, pos); any version but 1 is refused (O-13)."""
    doc = spark.read.schema(UNITS).option("multiLine", True).json(path)
    version = doc.select("version").first()
    if version is None or version[0] != 1:
        raise ValueError(f"catalog version {version and version[0]} is not 1")
    rows = doc.select(F.posexplode("units").alias("pos", "u"))
    text = lambda c: F.coalesce(F.col(f"u.{c}"), F.lit("")).alias(c)
    return rows.select(text("template"), text("korean"), text("rep"), text("class"), F.coalesce("u.members", F.lit(0)).cast("long").alias("members"), F.col("pos").cast("long").alias("pos"))


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """(term, rendering) (O-14)."""
    doc = spark.read.schema("terms map<string,string>").option("multiLine", True).json(path)
    return doc.select(F.explode("terms").alias("term", "rendering"))
