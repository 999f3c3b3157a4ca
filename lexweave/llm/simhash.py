"""SimHash near-duplicates by pivot distance tables.

Every distinct fingerprint carries its Hamming distances to fixed reference fingerprints (pivots).
Fingerprints within ``radius`` bits agree on at least two of six bit blocks, so candidates meet in the
buckets of block pairs; in a bucket, pairs whose distances to any pivot differ by more than the radius
are discarded (triangle inequality) and the survivors are verified. A bucket gives only the edges of a
spanning forest, never its pairs, and a large one is dealt out as blocks against blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm._common import cut, map_rows
from lexweave.shipping import ship

#: Bits in which two near-duplicates may differ.
RADIUS = 4
#: Bit blocks; any RADIUS changed bits leave at least two of them untouched.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Distances kept for each fingerprint, one byte each, in one long.
PIVOTS = 8
#: Members of a bucket that one task compares with as many others.
BLOCK_ROWS = 4096
SHINGLE_WORDS = 4
SEED = 42


def pivots() -> list[int]:
    """The reference fingerprints: hashes of their numbers, the same on every machine."""
    return [xxhash.xxh64_intdigest(str(k), 7) for k in range(PIVOTS)]


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 for none."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        part = hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None) -> int:
    """Majority bits of the XXH64 of a text's 4-word shingles; 0 where there is no word."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    stops = ends[min(SHINGLE_WORDS, len(words)) - 1 :]
    return majority(np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): the signed 64-bit SimHash of every row; null and empty texts have 0."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def each(rows: dict[str, list]) -> dict[str, list]:
        fps = np.array([fingerprint(t) for t in rows[text_col]], np.uint64)
        return {"fp": fps.view(np.int64)}

    return map_rows(df.select(id_col, text_col), schema, each)


def _bands(fp: F.Column) -> F.Column:
    """One key for each pair of bit blocks: the pair's number above the bits of both."""
    at, parts = 0, []
    for size in BLOCKS:
        parts.append((F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << size) - 1)), size))
        at += size
    keys = [
        F.shiftleft(a, m).bitwiseOR(b).bitwiseOR(F.lit(k << 22).cast("long"))
        for k, ((a, _), (b, m)) in enumerate(combinations(parts, 2))
    ]
    return F.array(*keys)


def distances(fp: F.Column) -> F.Column:
    """The pivot table's row of a fingerprint: one byte for each distance."""
    out = F.lit(0).cast("long")
    for k, p in enumerate(pivots()):
        signed = p - (1 << 64) if p >> 63 else p
        out = out.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(signed))).cast("long"), 8 * k))
    return out


def roots(n: int, u: np.ndarray, v: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest reachable position of each of n positions, by the links u-v and those already in ``label``."""
    label = np.arange(n) if label is None else label
    while True:
        a, b = label[u], label[v]
        open_ = a != b
        if not open_.any():
            return label
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label = up


def _pairs_of_small(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within short runs of rows."""
    us, vs = [], []
    for d in range(1, int(size.max(initial=1))):
        room = size - d
        s, r = start[room > 0], room[room > 0]
        at = np.repeat(s - np.concatenate(([0], np.cumsum(r)[:-1])), r) + np.arange(r.sum())
        us.append(at)
        vs.append(at + d)
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.empty(0, int), np.empty(0, int))


def _near(fp: np.ndarray, table: np.ndarray, u: np.ndarray, v: np.ndarray, radius: int):
    """Of candidate pairs, those the pivot table can't discard and whose bits then prove near."""
    for k in range(table.shape[1]):
        keep = np.abs(table[u, k] - table[v, k]) <= radius
        u, v = u[keep], v[keep]
    keep = np.bitwise_count(fp[u] ^ fp[v]) <= radius
    return u[keep], v[keep]


def _large_run(fp: np.ndarray, table: np.ndarray, radius: int, tile: int = 256) -> np.ndarray:
    """Labels in one large bucket block: rows in order of the first pivot meet only rows in reach of it."""
    order = np.argsort(table[:, 0], kind="stable")
    fp, table = fp[order], table[order]
    label = np.arange(len(fp))
    for at in range(0, len(fp), tile):
        end = min(at + tile, len(fp))
        stop = int(np.searchsorted(table[:, 0], table[end - 1, 0] + radius, side="right"))
        far = np.zeros((end - at, stop - at), bool)
        for k in range(1, 3):
            far |= np.abs(table[at:end, None, k] - table[None, at:stop, k]) > radius
        u, v = np.nonzero(~far)
        u, v = u + at, v + at
        keep = (u < v) & (label[u] != label[v])
        u, v = _near(fp, table, u[keep], v[keep], radius)
        label = roots(len(fp), u, v, label)
    out = np.empty(len(fp), np.int64)
    out[order] = order[label]
    return out


def _edges(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Spanning edges of each run of equal (band, block), from rows sorted by it."""
    held: list[pa.RecordBatch] = []

    def work(part: pa.Table) -> pa.RecordBatch:
        band, block, node, fp, dist = (part.column(k).to_numpy() for k in range(5))
        fp = fp.view(np.uint64)
        table = np.ascontiguousarray(dist).view(np.uint8).reshape(-1, 8)[:, :PIVOTS].astype(np.int16)
        new = np.ones(len(band), bool)
        new[1:] = (band[1:] != band[:-1]) | (block[1:] != block[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(band)))
        small = size <= 32
        u, v = _near(fp, table, *_pairs_of_small(start[small], size[small]), radius)
        label = roots(len(band), u, v)
        for s, n in zip(start[~small], size[~small], strict=True):
            label[s : s + n] = s + _large_run(fp[s : s + n], table[s : s + n], radius)
        a, b = node, node[label]
        keep = a != b
        return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        # rows of the last run wait for the next batch; a run holds two blocks at most
        keys = [batch.column(k).to_numpy() for k in (0, 1)]
        differs = np.flatnonzero((keys[0] != keys[0][-1]) | (keys[1] != keys[1][-1]))
        split = int(differs[-1]) + 1 if len(differs) else 0
        if held and split == 0 and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) == (keys[0][0], keys[1][0]):
            held.append(batch)
            continue
        yield work(pa.Table.from_batches([*held, batch.slice(0, split)]))
        held = [batch.slice(split)]
    if held:
        yield work(pa.Table.from_batches(held))


def links(nodes: DataFrame, radius: int = RADIUS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(u, v): edges that join distinct fingerprints within ``radius`` bits, directly or over others.

    ``nodes`` (node, fp) holds each fingerprint once. Exact: block pairs find every pair within four
    bits, and a bucket of more than ``block_rows`` members is compared block against block, each in a
    task of its own.
    """
    if radius > len(BLOCKS) - 2:
        raise ValueError("the bit blocks guarantee only four differing bits")
    wide = nodes.select("node", "fp", F.explode(_bands(F.col("fp"))).alias("band"))
    full = wide.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = wide.join(full, "band").withColumn("blocks", F.ceil(F.col("members") / F.lit(block_rows)).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    met = (
        met.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "band",
            (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).cast("long").alias("block"),
            "node",
            "fp",
            distances(F.col("fp")).alias("dist"),
        )
    )
    ship(nodes.sparkSession)
    dealt = met.repartition("band", "block").sortWithinPartitions("band", "block")
    return dealt.mapInArrow(lambda batches: _edges(batches, radius), "u long, v long").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node either has one smaller neighbour, always the same, or larger ones only."""
    end = lambda node, smaller: F.struct(F.col(node).alias("node"), smaller.cast("long").alias("smaller"))
    ends = edges.select(F.explode(F.array(end("u", F.col("v")), end("v", F.lit(None)))).alias("e")).select("e.*")
    facts = ends.groupBy("node").agg(F.min("smaller").alias("a"), F.max("smaller").alias("b"), F.count_if(F.col("smaller").isNull()).alias("above"))
    return not facts.where("a <> b or a is not null and above > 0").agg(F.count(F.lit(1))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable over the edges (u, v), for nodes that have one.

    Alternating large-star and small-star steps, each a partial aggregation and a join, until only stars
    are left; the edge table is cut to the shared checkpoint folder after each round, and one number a
    round comes to the driver. Loops and edges with a null end count for nothing, repeated ones once.
    """
    edge = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    both_of = lambda df, *es: df.select(F.explode(F.array(*es)).alias("e")).select("e.u", "e.v")
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    while not _are_stars(edges):
        both = both_of(edges, edge("u", "v"), edge("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = cut(both_of(large.join(least, "u"), edge("v", "m"), edge("u", "m")).where("u <> v").distinct())
    pair = lambda node: F.struct(F.col(node).alias("node"), F.col("v").alias("component"))
    return edges.select(F.explode(F.array(pair("u"), pair("v"))).alias("e")).select("e.*").distinct()


def near_duplicates(df: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long, component_id): each row's fingerprint and the smallest id of its near-duplicate class.

    Ids are integers; rows with a null id take part in no class and get a null component. Null and
    empty texts share fingerprint 0 and are linked like any other. Equal texts meet in one fingerprint
    before any comparison, so groups of copies cost one row.
    """
    fps = cut(fingerprints(df, id_col, text_col))
    nodes = fps.where(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).cast("long").alias("node"))
    nodes = cut(nodes)
    found = components(links(nodes, radius))
    classes = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = fps.join(classes, "fp", "left").select(id_col, "fp", "component_id")
    return out.withColumn("component_id", F.when(F.col(id_col).isNotNull(), F.col("component_id")))


def dedup(df: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose id is the smallest of its near-duplicate class, with all their columns.

    Ids should be unique: rows that share the kept id all stay. Rows without an id stay.
    """
    found = near_duplicates(df, radius, id_col, text_col)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return df.join(gone, id_col, "left_anti").select(*df.columns)
