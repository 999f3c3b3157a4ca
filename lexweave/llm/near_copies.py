"""SimHash near-duplicates from a Jaccard similarity on: pivot distance tables at a wide radius.

Each text has a SimHash of its set of five-word shingles and that fingerprint's distances to the pivots.
Texts meet where they can be similar: in one order of all shingles, two sets as similar as ``least`` share
one of the first shingles of each (its prefix). The order puts strata of frequency one after the other, rare
shingles first, and goes by hash within them, so of each stratum the first ``DEPTH`` shingles are enough. Of the pairs that meet, the pivot table
discards what the triangle inequality rules out, the fingerprints' bits what is farther than ``RADIUS``,
the sets' parities what differs too much for certain, and the whole sets of the survivors decide. Neighbours in each meeting place are compared first, then only
pairs that aren't joined already, so a large group of near copies doesn't give all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm import simhash
from lexweave.llm._common import cut, map_rows
from lexweave.llm.simhash import components
from lexweave.shipping import ship

SHINGLE_WORDS = 5
#: Similarity from which two texts are near copies.
LEAST = Fraction(4, 5)
#: Bits in which near copies differ at most: sets at 0.8 differ in 10 of 64 bits on average, 12 if short, so
#: this is four standard deviations and more above.
RADIUS = 24
#: Shingles of each stratum in a prefix that bring a text to a meeting place. Of a stratum that two sets share
#: to the part q, none is among the first of both with a chance of (1 - q) to this power: below 1e-16 at 0.8,
#: 4e-5 at the 0.35 that sets at 0.8 have in their rare stratum if the rest, four fifths, is frequent and equal.
DEPTH = 24
#: Texts whose shingles are counted for the strata.
SAMPLE_DOCS = 5000
#: Count in the sample from which a shingle is frequent, and texts that one task chains at a frequent one, about.
FREQUENT, CHAIN_ROWS = 2, 100_000
#: Texts before it, in order of their keys, that a text is compared with first at each meeting place.
CHAINED = 12
SEED = 42
#: Bits of the map that tells which texts to read again; a full map only reads more of them.
MAP_BITS = 25
#: Longs of a set's parity bits.
PARITY = 8
#: Keys that a task remembers, so that exact copies in it give their prefix once.
REMEMBERED = 1 << 18


def shingles(text: str | None) -> np.ndarray:
    """The sorted XXH64 of a text's distinct five-word shingles; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.int64)
    h, size = xxhash.xxh64_intdigest, SHINGLE_WORDS
    n = max(1, len(words) - size + 1)
    return np.unique(np.fromiter((h(b" ".join(words[k : k + size]), SEED) for k in range(n)), np.uint64, n).view(np.int64))


def prefix(found: np.ndarray, frequent: np.ndarray, counts: np.ndarray, least: Fraction = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a set that bring it to meeting places, and their counts in the sample, 0 for rare ones."""
    room = len(found) - -(-least.numerator * len(found) // least.denominator) + 1
    count = np.zeros(len(found), np.int64)
    if len(found) and len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        count = np.where(frequent[at] == found, counts[at], 0)
    stratum = np.frexp(count)[1]
    first = np.lexsort((found, stratum))[:room]
    ordered = stratum[first]
    first = first[np.arange(len(first)) - np.searchsorted(ordered, ordered) < DEPTH]
    return found[first], count[first]


def parity(found: np.ndarray) -> np.ndarray:
    """512 bits, each whether an odd number of shingles falls on it: sets that differ in n shingles differ in at most n bits."""
    odd = np.bincount(found & (64 * PARITY - 1), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _chained(batches: Iterator[pa.RecordBatch], alone: bool) -> Iterator[pa.RecordBatch]:
    """(token, key, before) of rows (place..., key) in order, where the first place is the token.

    ``before`` holds the last ``CHAINED`` keys before a row's in the same place. Equal rows count once;
    rows that are alone in their place are left out unless ``alone``. A place is held in memory.
    """
    held: list[pa.RecordBatch] = []

    def work(part: pa.Table) -> pa.RecordBatch:
        *place, key = (part.column(k).to_numpy() for k in range(part.num_columns))
        new = np.ones(len(key), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in place])
        once = new.copy()
        once[1:] |= key[1:] != key[:-1]
        token, key, new = place[0][once], key[once], new[once]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(key)))
        rank = np.arange(len(key)) - np.repeat(start, size)
        keep = (np.repeat(size, size) > 1) | alone
        at = np.flatnonzero(keep)
        n = np.minimum(rank[at], CHAINED)
        flat = key[np.repeat(at - n, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        before = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(flat))
        return pa.RecordBatch.from_arrays([pa.array(token[at]), pa.array(key[at]), before], names=["token", "key", "before"])

    for batch in batches:
        if not batch.num_rows:
            continue
        places = [batch.column(k).to_numpy() for k in range(batch.num_columns - 1)]
        last = tuple(c[-1] for c in places)
        differs = np.flatnonzero(np.logical_or.reduce([c != x for c, x in zip(places, last, strict=True)]))
        split = int(differs[-1]) + 1 if len(differs) else 0
        if held and split == 0 and tuple(held[0].column(k)[0].as_py() for k in range(len(places))) == last:
            held.append(batch)
            continue
        yield work(pa.Table.from_batches([*held, batch.slice(0, split)]).combine_chunks())
        held = [batch.slice(split)]
    if held:
        yield work(pa.Table.from_batches(held).combine_chunks())


def near(u: Column, v: Column, least: Fraction, radius: int = RADIUS) -> Column:
    """Whether two marks (size, fp, dist, parity) may be similar.

    By the sizes, by the pivot table, by the fingerprints' bits, and by the parities: sets as similar as
    ``least`` differ in at most (1 - least) / (1 + least) of their shingles.
    """
    a, b = least.numerator, least.denominator
    byte = lambda m, k: F.shiftrightunsigned(m["dist"], 8 * k).bitwiseAND(F.lit(255))
    apart = F.greatest(*(F.abs(byte(u, k) - byte(v, k)) for k in range(simhash.PIVOTS)))
    odd = sum((F.bit_count(u["parity"][k].bitwiseXOR(v["parity"][k])) for k in range(PARITY)), F.lit(0))
    return (
        F.when(F.least(u["size"], v["size"]) * b < F.greatest(u["size"], v["size"]) * a, False)
        .when(apart > radius, False)
        .when(F.bit_count(u["fp"].bitwiseXOR(v["fp"])) > radius, False)
        .otherwise(odd * (a + b) <= (u["size"] + v["size"]) * (b - a))
    )


def _sets(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(row, set) of the texts whose ``row`` is in ``wanted``, and of a few more.

    A bitmap of bounded size tells most other texts apart before their shingles are made; the join that
    follows is exact.
    """
    bit = F.xxhash64("row.file", "row.at").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    one = F.expr("shiftleft(1L, int(bit & 63))")
    words = wanted.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(one).alias("bits"))
    found = np.array([tuple(r) for r in words.collect()], np.int64).reshape(-1, 2)
    flags = np.zeros(1 << MAP_BITS - 6, np.int64)
    flags[found[:, 0]] = found[:, 1]
    shared = docs.sparkSession.sparkContext.broadcast(flags)
    names = ["row", "set"]
    row = docs.schema["row"].dataType

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column(1).to_numpy()
            mask = (shared.value[bits >> 6] >> (bits & 63)) & 1 == 1
            some = batch.filter(pa.array(mask))
            for at in range(0, some.num_rows, 256):
                part = some.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t) for t in part.column(2).to_pylist()], pa.list_(pa.int64()))], names=names)

    schema = T.StructType([T.StructField("row", row), T.StructField("set", T.ArrayType(T.LongType()))])
    return docs.select("row", bit.alias("bit"), "text").mapInArrow(each, schema)


def _similar(pairs: DataFrame, marks: DataFrame, docs: DataFrame, least: Fraction) -> DataFrame:
    """Of candidate pairs (u, v) of keys, those whose whole sets are similar. ``marks``: (key, row, size, fp, dist, parity)."""
    a, b = least.numerator, least.denominator
    mark = lambda k: marks.select(F.col("key").alias(k), F.struct("size", "fp", "dist", "parity", "row").alias(f"{k}_mark"))
    pairs = pairs.join(mark("u"), "u").join(mark("v"), "v").where(near(F.col("u_mark"), F.col("v_mark"), least))
    pairs = cut(pairs.select("u", "v", F.col("u_mark.row").alias("u_row"), F.col("v_mark.row").alias("v_row")))
    sets = _sets(pairs.select(F.explode(F.array("u_row", "v_row")).alias("row")), docs)
    left, right = (sets.select(F.col("row").alias(f"{k}_row"), F.col("set").alias(f"{k}_set")) for k in "uv")
    common, total = F.size(F.array_intersect("u_set", "v_set")), F.size("u_set") + F.size("v_set")
    return pairs.join(left, "u_row").join(right, "v_row").where(common * (a + b) >= total * a).select("u", "v")


def classes(df: DataFrame, least: Fraction = LEAST, row_col: str = "row", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, class) of every row: texts linked by similarity, directly or over others, share a class.

    ``row_col`` tells the rows apart (``numbered``). Texts of equal shingles meet in one key before any
    comparison; null texts and those without words are equal. A link is missed only by the small chances
    that are stated at ``RADIUS`` and ``DEPTH``, or where hashes of 64 bits are equal.
    """
    spark = df.sparkSession
    ship(spark)
    docs = df.select(F.col(row_col).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = max(1, docs.count())
    share = SAMPLE_DOCS / total
    place = F.shiftrightunsigned(F.xxhash64("row.file", "row.at"), 11).cast("double") / float(1 << 53)

    def sample(rows: dict[str, list]) -> dict[str, list]:
        return {"token": np.concatenate([np.empty(0, np.int64), *(shingles(t) for t in rows["text"])])}

    tokens = map_rows(docs.where(place <= share).select("text"), T.StructType([T.StructField("token", T.LongType())]), sample)
    often = sorted(tuple(r) for r in tokens.groupBy("token").count().where(F.col("count") >= FREQUENT).collect())
    table = np.array(often, np.int64).reshape(-1, 2)
    order = spark.sparkContext.broadcast((table[:, 0].copy(), table[:, 1].copy()))
    scale = max(1.0, 1 / share) / CHAIN_ROWS

    emitted: set[int] = set()

    def each(rows: dict[str, list]) -> dict[str, list]:
        sets = [shingles(t) for t in rows["text"]]
        keys = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        fps = np.array([simhash.majority(s.view(np.uint64)) for s in sets], np.uint64).view(np.int64)
        out: dict[str, list] = {"key": keys, "size": [len(s) for s in sets], "fp": fps, "parity": [parity(s) for s in sets], "prefix": [], "hot": []}
        for s, k in zip(sets, keys.tolist(), strict=True):
            if k in emitted:
                s = s[:0]
            elif len(emitted) >= REMEMBERED:
                emitted.clear()
            emitted.add(k)
            first, counts = prefix(s, *order.value, least)
            parts = np.ceil(counts * scale).astype(int)
            out["prefix"].append(first[parts <= 1])
            out["hot"].append([{"token": t, "parts": p} for t, p in zip(first[parts > 1].tolist(), parts[parts > 1].tolist(), strict=True)])
        return out

    long, longs = T.LongType(), T.ArrayType(T.LongType())
    hot = T.ArrayType(T.StructType([T.StructField("token", long), T.StructField("parts", T.IntegerType())]))
    schema = T.StructType([*(docs.schema[c] for c in ("row", "id")), T.StructField("key", long), T.StructField("size", T.IntegerType()), T.StructField("fp", long), T.StructField("parity", longs), T.StructField("prefix", longs), T.StructField("hot", hot)])
    rows = cut(map_rows(docs, schema, each))
    wide = rows.select(F.explode("prefix").alias("token"), "key").repartition("token").sortWithinPartitions("token", "key")
    chain = "token long, key long, before array<long>"
    met = wide.mapInArrow(lambda batches: _chained(batches, False), chain)
    # a shingle of very many texts is chained in parts, and its parts meet in the comparison of what isn't joined
    common = rows.select(F.explode("hot").alias("h"), "key").distinct().select("h.token", F.pmod(F.xxhash64("key"), F.col("h.parts")).alias("part"), "key")
    parts = common.repartition("token", "part").sortWithinPartitions("token", "part", "key").mapInArrow(lambda batches: _chained(batches, True), chain)
    met = cut(met.unionByName(parts))

    firsts = rows.groupBy("key").agg(F.min("row").alias("row")).join(met.select("key").distinct(), "key").select("row")
    facts = ("size", "fp", "dist", "parity")
    marks = cut(rows.join(firsts, "row").select("key", "row", simhash.distances(F.col("fp")).alias("dist"), "size", "fp", "parity"))
    chained = cut(met.select(F.explode("before").alias("u"), F.col("key").alias("v")).distinct())
    edges = cut(_similar(chained, marks, docs, least))
    stars = components(edges)
    joined = met.select("token", "key").join(stars.withColumnRenamed("node", "key"), "key", "left")
    joined = joined.select("token", "key", F.coalesce("component", "key").alias("component"))
    # where texts of several components meet, those outside the largest one are compared with all
    open_ = joined.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("token")
    joined = cut(joined.join(open_, "token"))
    sizes = joined.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("token").agg(F.max(F.struct("n", "component")).alias("m")).select("token", F.col("m.component").alias("largest"))
    mark = F.struct("key", "component", *facts)
    known = joined.join(marks.select("key", *facts), "key")
    outside = known.join(largest, "token").where("component <> largest").select("token", "largest", mark.alias("u"))
    u, v = F.col("u"), F.col("v")
    once = (v["component"] == F.col("largest")) | (u["key"] < v["key"])
    pairs = outside.join(known.select("token", mark.alias("v")), "token").where((u["component"] != v["component"]) & once & near(u, v, least))
    pairs = pairs.select(F.least("u.key", "v.key").alias("u"), F.greatest("u.key", "v.key").alias("v")).distinct()
    more = _similar(pairs.join(chained, ["u", "v"], "left_anti"), marks, docs, least)
    found = components(stars.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)).select(F.col("node").alias("key"), F.col("component").alias("class"))
    return rows.select("row", "id", "key").join(found, "key", "left").select("row", "id", F.coalesce("class", "key").alias("class"))


def dedup(df: DataFrame, least: Fraction = LEAST, row_col: str = "row", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of near copies, with all columns: that of the smallest id; nulls come last, equal ids by row."""
    known = cut(classes(df, least, row_col, id_col, text_col))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("row").alias("at")))
    kept = known.groupBy("class").agg(first.alias("first")).select(F.col("first.at").alias("row"))
    gone = known.select("row").join(kept, "row", "left_anti").select(F.col("row").alias(row_col))
    return df.join(gone, row_col, "left_anti").select(*df.columns)
