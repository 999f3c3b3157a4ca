"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet on shared five-word seeds. Each pair that meets is tiled: the longest
common word runs that don't overlap are marked first, found by running Karp-Rabin hashes of falling
length. The share of the item's words under tiles tells contamination, so reordered passages count too.
"""

from __future__ import annotations

import heapq
import re
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm._common import cut, map_rows, numbered

#: Words of a seed and of the shortest tile.
LEAST_WORDS = 5
#: Share of an item's words under tiles from which the document is contaminated.
COVERAGE = 0.8
#: Benchmark items and bytes that are sent to the tasks at once; a larger benchmark is taken in blocks.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
WORD = re.compile(r"\w+")
BASE, MASK = 0x100000001B3, (1 << 64) - 1


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _windows(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``size`` numbers, modulo 2 to the 64."""
    n = max(0, len(ids) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(BASE) + ids[k : k + n].astype(np.uint64)
    return out


def _rolling(ids: list[int], marked: bytearray, size: int):
    """(place, hash) of each run of ``size`` unmarked numbers, each hash made from the one before."""
    lead = pow(BASE, size - 1, MASK + 1)
    h = run = 0
    for end, x in enumerate(ids):
        if marked[end]:
            h = run = 0
            continue
        if run >= size:
            h = (h - ids[end - size] * lead) & MASK
        h = (h * BASE + x) & MASK
        run += 1
        if run >= size:
            yield end - size + 1, h


def tile(item: list[int], text: list[int], least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in text, words): longest first, earliest first, never overlapping.

    Negative numbers in ``text`` match nothing. Search lengths fall from the item's length by halves to
    ``least``; at each, all maximal matches of at least that length wait in a queue, longest first. What a
    tile leaves of a match goes back into the queue by its own length, so no shorter one is marked before it.
    """
    in_item, in_text = bytearray(len(item)), bytearray(x < 0 for x in text)
    tiles: list[tuple[int, int, int]] = []
    size, left = min(len(item), len(text)), len(item)
    while size >= least and left >= least:
        seeds: dict[int, list[int]] = {}
        for at, h in _rolling(item, in_item, size):
            seeds.setdefault(h, []).append(at)
        queue: list[tuple[int, int, int]] = []
        for b, h in _rolling(text, in_text, size) if seeds else ():
            for a in seeds.get(h, ()):
                if a and b and item[a - 1] == text[b - 1] and not (in_item[a - 1] or in_text[b - 1]):
                    continue  # part of a longer match that starts earlier
                n = 0
                while a + n < len(item) and b + n < len(text) and item[a + n] == text[b + n] and not (in_item[a + n] or in_text[b + n]):
                    n += 1
                if n >= size:
                    queue.append((-n, a, b))
        heapq.heapify(queue)
        while queue and left >= size:
            n, a, b = heapq.heappop(queue)
            n, run = -n, 0
            parts = []
            for k in range(n + 1):
                if k < n and not (in_item[a + k] or in_text[b + k]):
                    run += 1
                    continue
                if run >= size:
                    parts.append((-run, a + k - run, b + k - run))
                run = 0
            if parts != [(-n, a, b)]:
                for part in parts:
                    heapq.heappush(queue, part)
                continue
            in_item[a : a + n] = in_text[b : b + n] = b"\1" * n
            tiles.append((a, b, n))
            left -= n
        if size == least:
            break
        size = max(least, size // 2)
    return tiles


class Items:
    """A bounded block of benchmark items with its seed index."""

    def __init__(self, rows: list[tuple[int, str]], least: int = LEAST_WORDS):
        self.least = least
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary.setdefault
        self.items = [(i, [number(w, len(self.vocabulary)) for w in words(t)]) for i, t in rows]
        hashes = [_windows(np.array(ids, np.int64), least) for _, ids in self.items]
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        order = np.argsort(flat, kind="stable")
        self.seeds, self.owners = flat[order], owner[order]

    def search(self, text: str | None) -> list[tuple[int, float, list[tuple[int, int, int]]]]:
        """(item, coverage, tiles) of each item that shares a seed with the text; tiles count words."""
        if not text or not len(self.seeds):
            return []
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words(text)], np.int64)
        if len(ids) < self.least:
            return []
        h = _windows(ids, self.least)
        low = np.searchsorted(self.seeds, h)
        hit = (self.seeds[np.minimum(low, len(self.seeds) - 1)] == h) & (np.convolve(ids < 0, np.ones(self.least), "valid") == 0)
        if not hit.any():
            return []
        # only words under some seed can be in a tile: keep those, with a barrier between stretches
        under = np.zeros(len(ids), bool)
        places = np.flatnonzero(hit)
        for k in range(self.least):
            under[places + k] = True
        kept = np.flatnonzero(under)
        gaps = np.flatnonzero(np.diff(kept) > 1) + 1
        short = np.insert(ids[kept], gaps, -1).tolist()
        back = np.insert(kept, gaps, -1)
        first, last = low[hit], np.searchsorted(self.seeds, h[hit], side="right")
        owners = {int(o) for a, b in set(zip(first.tolist(), last.tolist(), strict=True)) for o in self.owners[a:b]}
        out = []
        for o in sorted(owners):
            item_id, item = self.items[o]
            tiles = [(a, int(back[b]), n) for a, b, n in tile(item, short, self.least)]
            out.append((item_id, sum(n for _, _, n in tiles) / len(item), tiles))
        return out


def matches(docs: DataFrame, bench: DataFrame, least: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, matches array<struct<item_id, coverage, tiles>>): every row, with the items it shares a tile with.

    Null and empty texts match nothing; items of fewer than ``least`` words have no seed and match
    nothing; items that share an id are matched apart. The benchmark's size is measured first: up to the
    block bound it is sent to the tasks whole, a larger one block after block, so that driver and tasks
    hold one at a time, each against all documents, whose rows are numbered before. Every row gives one
    row, whatever its id.
    """
    bench = bench.where(F.col(item_text).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    n, size = bench.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    span = T.StructType([T.StructField(k, T.IntegerType()) for k in ("item_word", "doc_word", "words")])
    match = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("tiles", T.ArrayType(span))])
    found_of = T.StructField("matches", T.ArrayType(match))
    rows = docs.select(id_col, text_col)

    def search(block: DataFrame, rows: DataFrame, key: str) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(Items([tuple(r) for r in block.orderBy("item_id", "text").collect()], least))

        def each(rows: dict[str, list]) -> dict[str, list]:
            names = ("item_word", "doc_word", "words")
            found = [
                [{"item_id": i, "coverage": c, "tiles": [dict(zip(names, t, strict=True)) for t in tiles]} for i, c, tiles in shared.value.search(text)]
                for text in rows[text_col]
            ]
            return {"matches": found}

        return map_rows(rows, T.StructType([rows.schema[key], found_of]), each)

    if blocks == 1:
        return search(bench, rows, id_col)
    rows = numbered(docs.select(id_col, text_col), "_row")
    block_of = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    parts = [cut(search(bench.where(block_of == b), rows.select("_row", text_col), "_row").where("size(matches) > 0")) for b in range(blocks)]
    both = reduce(DataFrame.unionByName, parts)
    # as from one block: by item; those of one item are in one block and keep their order
    by_item = lambda a, b: F.when(a["item_id"] < b["item_id"], -1).when(a["item_id"] > b["item_id"], 1).otherwise(0)
    merged = both.groupBy("_row").agg(F.array_sort(F.flatten(F.collect_list("matches")), by_item).alias("matches"))
    return rows.select("_row", id_col).join(merged, "_row", "left").select(id_col, F.coalesce("matches", F.array().cast(found_of.dataType)).alias("matches"))


def contamination(docs: DataFrame, bench: DataFrame, coverage: float = COVERAGE, **columns) -> DataFrame:
    """(id, contaminated, coverage, item_ids): each row's verdict, its best coverage and the items it leaks."""
    found = matches(docs, bench, **columns)
    id_col = found.columns[0]
    leaked = F.filter("matches", lambda m: m["coverage"] >= coverage)
    return found.select(
        id_col,
        (F.size(leaked) > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0)).alias("coverage"),
        F.array_sort(F.array_distinct(F.transform(leaked, lambda m: m["item_id"]))).alias("item_ids"),
    )
