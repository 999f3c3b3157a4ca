"""Exact top-k inner-product search with a distributed M-tree.

Vectors get one more coordinate that makes all their lengths equal, so the greatest inner product is the
least Euclidean distance. The top page is shared: a bounded number of routing objects with covering radii,
each vector under the nearest one. Below, each routing object has subtrees of pages, whose entries hold
their distance to the page's routing object and a covering radius. A query searches one subtree of its
nearest routing object first; the k-th best score found there is a bound, and only subtrees that can still
win by it are visited. Within a subtree pages open best bound first, and an entry that its stored parent
distance already rules out by the triangle inequality costs no distance computation.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm._common import cut
from lexweave.shipping import ship

#: Entries of a page.
PAGE = 256
#: Squared lengths below this have scores that floats hold exactly.
EXACT = 2.0**52
#: Scores are clamped to 64 bits.
MOST = 2**63 - 1
#: Vectors of a subtree, on average; routing objects of the top page, at most, and rows that they are chosen from.
TREE_ROWS, ROUTES, SAMPLE_ROWS = 32_768, 1024, 1024
#: Fewest subtrees, so that small tables use several cores.
LEAST_TREES = 16
#: Queries that go through a subtree together.
QUERY_ROWS = 256
#: Slack of distance bounds, relative to the vectors' length; scores themselves are exact integers.
SLACK = 1e-7


def clamped(x: int) -> int:
    return max(-MOST, min(MOST, x))


class Tree:
    """An M-tree over vectors of whole numbers; equal vectors share an entry with their smallest ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, keep: int, top: float | None = None, page: int = PAGE):
        """``keep``: ids kept for each distinct vector; a top-k without the query itself needs k + 1. ``top``:
        the greatest squared length of all vectors, also those of other trees."""
        distinct, inverse = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, inverse.reshape(-1)))
        starts = np.searchsorted(inverse.reshape(-1)[order], np.arange(len(distinct)))
        stops = np.append(starts[1:], len(order))
        self.ids = [ids[order[a : min(b, a + keep)]].tolist() for a, b in zip(starts, stops, strict=True)]
        self.vectors = distinct.astype(float)
        self.norms = (self.vectors**2).sum(axis=1)
        self.top = max(float(self.norms.max(initial=0)), top or 0.0)
        #: The coordinate that makes all lengths equal.
        self.extra = np.sqrt(self.top - self.norms)
        #: Pages: (entries, distances to the page's routing object, radii or None in a leaf, child pages).
        self.pages: list[tuple] = []
        #: Pairs of a query and an entry whose distance or score was computed.
        self.computed = 0
        self.root = self._build(np.arange(len(distinct)), None, page) if len(distinct) else None

    def _page(self, entries: np.ndarray, route: int | None, radii: np.ndarray | None, children: list[int] | None) -> int:
        to_route = np.zeros(len(entries)) if route is None else self._between(entries, np.array([route]))[:, 0]
        self.pages.append((entries, to_route, radii, children))
        return len(self.pages) - 1

    def _build(self, rows: np.ndarray, route: int | None, page: int) -> int:
        if len(rows) <= page:
            return self._page(rows, route, None, None)
        fan = int(min(page, -(-2 * len(rows) // page)))
        routes = rows[np.linspace(0, len(rows) - 1, fan).astype(int)]
        far = self._between(rows, routes)
        owner = far.argmin(axis=1)
        # routing objects of few rows are given up, so pages stay filled
        full = np.flatnonzero(np.bincount(owner, minlength=fan) >= page // 4)
        if not len(full):
            full = np.arange(fan)
        owner = full[far[:, full].argmin(axis=1)]
        entries, radii, children = [], [], []
        for k in np.unique(owner):
            own = np.flatnonzero(owner == k)
            # rows that no routing object tells apart are cut all the same
            for part in np.array_split(own, fan) if len(own) == len(rows) else [own]:
                entries.append(routes[k])
                radii.append(float(far[part, k].max()))
                children.append(self._build(rows[part], int(routes[k]), page))
        return self._page(np.array(entries), route, np.array(radii), children)

    def _between(self, rows: np.ndarray, routes: np.ndarray) -> np.ndarray:
        plain = self.norms[rows, None] + self.norms[None, routes] - 2 * (self.vectors[rows] @ self.vectors[routes].T)
        return np.sqrt(np.maximum(plain + (self.extra[rows, None] - self.extra[None, routes]) ** 2, 0))

    def search(self, query_ids: list, queries: np.ndarray, k: int, floors: np.ndarray | None = None) -> list[list[tuple[int, int]]]:
        """Each query's k best (score, id), best first, ties to the smaller id, without the query's own id.

        ``floors``: scores of k hits elsewhere, below which a hit is of no use (-inf where there are none).
        """
        m = len(query_ids)
        best: list[list[tuple[int, int]]] = [[] for _ in range(m)]  # heaps of (score, -id)
        if self.root is None or not m:
            return best
        floor = np.full(m, -np.inf) if floors is None else floors.astype(float)
        lengths = (queries**2).sum(axis=1)
        level, exact = lengths + self.top, max(float(lengths.max()), self.top) < EXACT
        slack = SLACK * np.sqrt(level) + 1e-6
        reach = np.sqrt(np.maximum(level - 2 * floor, 0)) + slack
        # (whether it is the queries' nearest page, least bound, number, page, queries, their bounds, their
        # distances to the page's routing object): each query's nearest pages open before all others
        heap: list[tuple] = [(False, 0.0, 0, self.root, np.arange(m), np.zeros(m), None)]
        pushed = 1
        while heap:
            _, _, _, at, asked, bounds, to_route = heapq.heappop(heap)
            open_ = ~(bounds > reach[asked])  # what is too large to be compared stays open
            asked, bounds = asked[open_], bounds[open_]
            if not len(asked):
                continue
            entries, stored, radii, children = self.pages[at]
            may = np.ones((len(asked), len(entries)), bool)
            if to_route is not None:  # bounds from stored distances alone
                to_route = to_route[open_]
                low = np.abs(stored[None] - to_route[:, None]) - (0 if radii is None else radii[None])
                may = ~(low > reach[asked, None])
            columns = np.flatnonzero(may.any(axis=0))
            if not len(columns):
                continue
            may = may[:, columns]
            self.computed += may.size
            scores = queries[asked] @ self.vectors[entries[columns]].T
            if radii is None:
                self._take(best, query_ids, queries, asked, entries[columns], scores, may, k, floor, exact)
                reach[asked] = np.sqrt(np.maximum(level[asked] - 2 * floor[asked], 0)) + slack[asked]
                continue
            d = np.sqrt(np.maximum(level[asked, None] - 2 * scores, 0))
            low = np.maximum(bounds[:, None], d - radii[None, columns] - slack[asked, None])
            nearest = np.where(may, d, np.inf).argmin(axis=1)
            may &= ~(low > reach[asked, None])
            for n in range(len(columns)):
                for later in (False, True):
                    wanted = np.flatnonzero(may[:, n] & ((nearest != n) == later))
                    if len(wanted):
                        heapq.heappush(heap, (later, float(low[wanted, n].min()), pushed, children[columns[n]], asked[wanted], low[wanted, n], d[wanted, n]))
                        pushed += 1
        return [[(s, -i) for s, i in sorted(b, reverse=True)] for b in best]

    def _take(self, best, query_ids, queries, asked, entries, scores, may, k, floor, exact) -> None:
        """Puts a leaf's hits into the queries' heaps and raises their floors."""
        least = floor[asked].copy()
        if scores.shape[1] > k + 1:  # what k + 1 distinct vectors of a page exceed is never among the k best
            least = np.maximum(least, np.partition(np.where(may, scores, -np.inf), -(k + 1), axis=1)[:, -(k + 1)])
        if not exact:  # floats are near the scores
            least = least - SLACK * (1 + np.abs(least))
        rows, columns = np.nonzero(may & ~(scores < least[:, None]))
        for r, c in zip(rows.tolist(), columns.tolist(), strict=True):
            q, entry = asked[r], entries[c]
            s = int(scores[r, c]) if exact else clamped(sum(int(a) * int(b) for a, b in zip(queries[q], self.vectors[entry], strict=True)))
            heap = best[q]
            for i in self.ids[entry]:
                if i == query_ids[q]:
                    continue
                item = (s, -i)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
            if len(heap) == k:
                floor[q] = max(floor[q], float(heap[0][0]))


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id long, v array<double>): floor(256 * x) of each component, a whole number of any size.

    Vectors that are null, or hold a component that is null or non-finite (also 256 times it), and rows
    without an id are left out.
    """
    wide = F.transform(vector_col, lambda x: x.cast("double") * 256)
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(~bad)
    whole = F.transform(wide, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))
    return sound.select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one width."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


class Routes:
    """The top page: routing objects by width, and what is known of the vectors under each."""

    def __init__(self, vectors: list[np.ndarray], top: float, limit: int):
        self.top = top
        by_width: dict[int, list[np.ndarray]] = {}
        for v in vectors:
            own = by_width.setdefault(len(v), [])
            if sum(map(len, by_width.values())) <= limit or not own:  # each width that was sampled has one
                own.append(v)
        self.objects = {w: np.unique(np.array(own, float).reshape(len(own), w), axis=0) for w, own in by_width.items()}
        #: (width, route) -> (subtrees, covering radius).
        self.known: dict[tuple[int, int], tuple[int, float]] = {}

    def distances(self, vectors: np.ndarray, lengths: np.ndarray, extra: np.ndarray | None) -> np.ndarray:
        """Distances to the routing objects; ``extra`` is the coordinate that is added, 0 for a query."""
        objects = self.objects[vectors.shape[1]]
        own = (objects**2).sum(axis=1)
        added = np.sqrt(np.maximum(self.top - own, 0))[None] - (0 if extra is None else extra[:, None])
        plain = lengths[:, None] + own[None] - 2 * (vectors @ objects.T)
        return np.sqrt(np.maximum(plain + added**2, 0))


def _by_width(batch: pa.RecordBatch, name: str = "v") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, places, vectors) of a batch's rows."""
    column = batch.column(name)
    widths = column.value_lengths().to_numpy()
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        yield int(w), at, _matrix(column.take(pa.array(at)))


def _searched(batches: Iterator[pa.RecordBatch], k: int, top: float) -> Iterator[pa.RecordBatch]:
    """Hits of rows (width, route, tree, kind, id, v, floor), where each subtree's vectors (kind 0) come before its queries."""
    place, own, tree = None, [], None
    for batch in batches:
        keys = [batch.column(n).to_numpy() for n in ("width", "route", "tree", "kind")]
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in keys])
        starts = np.flatnonzero(new)
        for a, b in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
            here, part = tuple(int(c[a]) for c in keys[:3]), batch.slice(a, b - a)
            if here != place:
                place, own, tree = here, [], None
            ids, vectors = part.column("id").to_numpy(), _matrix(part.column("v"))
            if keys[3][a] == 0:
                own.append((ids, vectors))
                continue
            if tree is None:
                if not own:
                    continue
                tree = Tree(np.concatenate([x for x, _ in own]), np.concatenate([x for _, x in own]), k + 1, top)
                own = []
            floors = part.column("floor").to_numpy(zero_copy_only=False)
            for at in range(0, len(ids), QUERY_ROWS):
                some = slice(at, at + QUERY_ROWS)
                got = tree.search(ids[some].tolist(), vectors[some], k, np.where(np.isnan(floors[some]), -np.inf, floors[some]))
                found = [(q, i, s) for q, hits in zip(ids[some].tolist(), got, strict=True) for s, i in hits]
                columns = list(zip(*found, strict=True)) if found else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of greatest inner product for each query.

    Both tables hold (id, v) as ``quantised`` gives them. A candidate with the query's id is passed over;
    equal scores go to the smaller id; fewer candidates give fewer rows. Only vectors of the query's own
    width are candidates, as others have no inner product with it. Scores beyond 64 bits are clamped, and
    equal then. A repeated candidate counts as one more; a query id that is repeated is asked once, with
    its least vector. No subtree is copied: it is built where its queries arrive, which stream through it.
    """
    spark = candidates.sparkSession
    ship(spark)
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    n, top = candidates.agg(F.count(F.lit(1)), F.coalesce(F.max(square), F.lit(0.0))).first()
    trees = max(LEAST_TREES, -(-n // tree_rows))
    sample = candidates.orderBy(F.xxhash64("id")).limit(SAMPLE_ROWS).collect()
    routes = Routes([np.array(r["v"], float) for r in sample], top, min(ROUTES, trees))
    most = max(1, -(-n // trees))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width, route, far = np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, -1, np.int64), np.zeros(batch.num_rows)
            for w, at, vectors in _by_width(batch):
                width[at] = w
                if w in routes.objects:
                    lengths = (vectors**2).sum(axis=1)
                    d = routes.distances(vectors, lengths, np.sqrt(np.maximum(top - lengths, 0)))
                    route[at] = d.argmin(axis=1)
                    far[at] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(width), pa.array(route), pa.array(far)], names=["id", "v", "width", "route", "far"])

    where = "id long, v array<double>, width long, route long, far double"
    known = candidates.mapInArrow(placed, where)
    # the top page's radii and numbers of subtrees: a row for each routing object
    for r in known.where("route >= 0").groupBy("width", "route").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect():
        routes.known[r["width"], r["route"]] = (-(-r["n"] // most), r["radius"])

    def dealt(batches: Iterator[pa.RecordBatch], what: str) -> Iterator[pa.RecordBatch]:
        """Rows by subtree: a vector ("own") and a query's first search ("home") in one, a query's other
        searches ("rest") in all that its bound leaves."""
        names = ["width", "route", "tree", "id", "v", "floor"]
        for batch in batches:
            for w, at, vectors in _by_width(batch):
                ids = batch.column("id").to_numpy()[at]
                floor = batch.column("floor").to_numpy(zero_copy_only=False)[at].astype(float)
                known = sorted((route, *fact) for (width, route), fact in routes.known.items() if width == w)
                if not known:  # a width that wasn't sampled, so a rare one, is one subtree
                    pieces = [] if what == "rest" else [(np.full(len(ids), -1), np.zeros(len(ids), np.int64), np.arange(len(ids)))]
                else:
                    number, count = (np.array([f[x] for f in known]) for x in (0, 1))
                    lengths = (vectors**2).sum(axis=1)
                    # a query's own coordinate is 0: it only looks for directions
                    extra = np.sqrt(np.maximum(top - lengths, 0)) if what == "own" else None
                    d = routes.distances(vectors, lengths, extra)[:, number]
                    home = d.argmin(axis=1)
                    lot = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                    tree = (lot % count[home].astype(np.uint64)).astype(np.int64)
                    pieces = [(number[home], tree, np.arange(len(ids)))]
                    if what == "rest":
                        level, pieces = lengths + top, []
                        reach = np.sqrt(np.maximum(level - 2 * np.where(np.isnan(floor), -np.inf, floor), 0)) + 2 * SLACK * np.sqrt(level) + 1e-6
                        for k_, (route, trees_, radius) in enumerate(known):
                            near = ~(d[:, k_] - radius > reach)
                            for t in range(trees_):
                                rows = np.flatnonzero(near & ((home != k_) | (tree != t)))
                                pieces.append((np.full(len(rows), route), np.full(len(rows), t), rows))
                for route, tree, rows in pieces:
                    for a in range(0, len(rows), 4096):
                        part = rows[a : a + 4096]
                        spots = (np.full(len(part), w), route[a : a + 4096], tree[a : a + 4096])
                        yield pa.RecordBatch.from_arrays(
                            [*(pa.array(x.astype(np.int64)) for x in spots), pa.array(ids[part]), batch.column("v").take(pa.array(at[part])), pa.array(floor[part])],
                            names=names,
                        )

    spot = "width long, route long, tree long, id long, v array<double>, floor double"
    none = F.lit(float("nan")).alias("floor")

    def hits(asked: DataFrame) -> DataFrame:
        """Hits of dealt queries: subtrees and queries meet by sorting, vectors first."""
        own = candidates.select("id", "v", none).mapInArrow(lambda b: dealt(b, "own"), spot).withColumn("kind", F.lit(0).cast("long"))
        both = own.unionByName(asked.withColumn("kind", F.lit(1).cast("long")))
        sorted_ = both.repartition("width", "route", "tree").sortWithinPartitions("width", "route", "tree", "kind", "id")
        return sorted_.mapInArrow(lambda b: _searched(b, k, top), "query_id long, vec_id long, score long")

    once = queries.groupBy("id").agg(F.min("v").alias("v"))
    return _both(once, hits, lambda df, what: df.select("id", "v", "floor").mapInArrow(lambda b: dealt(b, what), spot), none, k)


def _both(once: DataFrame, hits, dealt, none, k: int) -> DataFrame:
    """Searches each query's own subtree, then the others that its bound leaves, and ranks what both found."""
    first = cut(hits(dealt(once.select("id", "v", none), "home")))
    bound = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    asked = once.join(bound.select(F.col("query_id").alias("id"), F.col("least").cast("double").alias("floor")), "id", "left")
    more = hits(dealt(asked.select("id", "v", F.coalesce("floor", none).alias("floor")), "rest"))
    # Spark cuts each task's queries to k rows before the shuffle
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = first.unionByName(more).withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
