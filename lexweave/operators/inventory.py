"""Groups, summaries and histograms of keyed text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import markup as M

CLASSES = ("empty", "reference", "prose")


def groups(entries: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(template, class, rep, members) for each template (O-62).

    Grouped on the skeleton, which has no numbering to compute, so the map-side aggregation is cheap;
    the numbered template and the class, which the skeleton decides, are made once for each group.
    """
    v = F.col(value)
    rows = entries.where(v.isNotNull()).select(F.col(key).alias("key"), M.skeleton(v).alias("skeleton"))
    return described(rows.groupBy("skeleton").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("members")))


def described(grouped: DataFrame) -> DataFrame:
    """Groups of skeletons, with their template and class in place of the skeleton."""
    skeleton = F.col("skeleton")
    return grouped.select(M.template_of(skeleton).alias("template"), M.class_of(skeleton).alias("class"), "rep", "members")


def members(entries: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(template, key, tokens, numbers) for each row: a group's members, one row each."""
    t = M.templatize(F.col(value))
    return entries.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), t.alias("t")).select("t.template", "key", "t.tokens", "t.numbers")


def nested_groups(entries: DataFrame, **columns) -> DataFrame:
    """Groups with their members nested and sorted, as reports write them (O-20, O-62)."""
    own = members(entries, **columns).groupBy("template").agg(F.array_sort(F.collect_list(F.struct("key", "tokens", "numbers"))).alias("members"))
    return groups(entries, **columns).drop("members").join(own, "template")


def ordered(grouped: DataFrame) -> DataFrame:
    """Largest groups first (O-76)."""
    return grouped.orderBy(F.desc("members"), "template")


def summary(entries: DataFrame, grouped: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """One row of totals by keys and by groups (O-63)."""
    c = M.classify(F.col(value))
    flag = F.col("malformed") if "malformed" in entries.columns else F.lit(False)
    by_key = entries.agg(
        F.count(F.lit(1)).alias("keys"),
        F.countDistinct(value).alias("values"),
        *(F.count_if(c == k).alias(f"{k}_keys") for k in CLASSES),
        F.count_if(flag).alias("malformed"),
    )
    by_group = grouped.agg(
        F.count(F.lit(1)).alias("groups"),
        *(F.count_if(F.col("class") == k).alias(f"{k}_groups") for k in CLASSES),
        F.coalesce(F.sum(F.when(F.col("class") == "prose", F.length("template"))), F.lit(0)).alias("prose_chars"),
    )
    # one row meets one row
    return by_key.withColumn("_one", F.lit(1)).join(by_group.withColumn("_one", F.lit(1)), "_one").drop("_one")


def duplicates(entries: DataFrame) -> DataFrame:
    """(key, places): keys defined more than once, with file:line in order (O-64)."""
    places = F.transform(F.array_sort(F.collect_list(F.struct("file", "line"))), lambda p: F.concat_ws(":", p["file"], p["line"].cast("string")))
    return entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), places.alias("places")).where("n > 1").drop("n")


def prefixes(entries: DataFrame, depth: int = 3, key: str = "key") -> DataFrame:
    """(prefix, n) of keys (O-65)."""
    return entries.groupBy(M.key_prefix(F.col(key), depth).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def foreign(entries: DataFrame) -> DataFrame:
    """Rows whose key lacks the namespace (O-42)."""
    return entries.where(~M.namespaced(F.col("key")))


def foreign_shapes(entries: DataFrame) -> DataFrame:
    """(shape, n, example) of foreign keys (O-66)."""
    return foreign(entries).groupBy(M.key_shape(F.col("key")).alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("example"))


def token_usage(entries: DataFrame, value: str = "value") -> DataFrame:
    """(kind, n, texts) of each of the seven kinds, also the unused (O-67)."""
    each = entries.select(F.explode(M.tokens(F.col(value))).alias("token"))
    # distinct tokens first: one row for each token and task reaches the shuffle
    counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    used = counts.groupBy(M.token_kind(F.col("token")).alias("kind")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
    kinds = entries.sparkSession.createDataFrame([(k,) for k in M.KINDS], "kind string")
    return kinds.join(used, "kind", "left").na.fill(0, ["n", "texts"])


def first_rows(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order (O-48, O-49): a minimum, not a sorted window."""
    rest = [c for c in df.columns if c != key]
    lead = [c for c in order if c != key]
    row = F.struct(*lead, *(c for c in rest if c not in lead))
    return df.groupBy(key).agg(F.min(row).alias("_r")).select(*(key if c == key else f"_r.{c}" for c in df.columns))


def top(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows of an order (O-79)."""
    return df.orderBy(*order).limit(n)


def top_each(df: DataFrame, n: int, key: str, *order) -> DataFrame:
    """The first n rows of each key (O-80); Spark cuts each task's groups before the shuffle."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("rank") <= n)


def distinct_keys(*trees: DataFrame) -> DataFrame:
    """(layer, key) of several trees, each once (O-47)."""
    out = trees[0].select("layer", "key")
    for t in trees[1:]:
        out = out.unionByName(t.select("layer", "key"))
    return out.distinct()


def batches(df: DataFrame, size: int = 40, order: str = "pos") -> DataFrame:
    """Adds batch (from 0) and id (from 1) in it, in order of an integer position (O-82); rows without one come last.

    Positions are ranked inside ranges and shifted by the counts before, so no task sorts the table.
    """
    last = F.lit(2**62)
    spark_ranges = df.withColumn("_range", F.coalesce(F.expr(f"{order} div 100000"), last))
    sizes = spark_ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    shifts = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_shift"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    out = spark_ranges.join(shifts, "_range").withColumn("_at", F.col("_shift") + rank)
    return out.withColumns({"batch": F.expr(f"_at div {size}"), "id": (F.col("_at") % size + 1)}).drop("_range", "_shift", "_at")
