"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = logistic(threshold_k - w.x): one weight vector serves all ordered thresholds. Features are
words and word beginnings; x counts a document's distinct words that have the feature.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm._common import cut, map_rows
from lexweave.llm.bpe_pairs import Bounded
from lexweave.shipping import ship

#: Labelled documents that training reads at most, on average; chosen by a hash of the id.
SAMPLE_DOCS = 12_000
#: Features that the model keeps at most: those that tell toxic documents best.
FEATURES = 4096
#: Standard errors and log-odds from which a feature is kept.
LEAST_Z, LEAST_ODDS = 3.0, 1.0
#: Share of the sample, and number of its documents, that must have a feature.
LEAST_SHARE, LEAST_DOCS = 1 / 400, 3
#: A toxic document's grade is 1 plus how many of these sums of evidence it exceeds. The evidence of a word
#: is the greatest log-odds among its features.
GRADE_STEPS = (6.0, 12.0)
#: Expected severity from which a document is toxic.
LIMIT = 0.5
#: Letters of the word beginnings that are features, so that inflected and compound words count too.
BEGINNINGS = range(3, 9)
WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in BEGINNINGS if len(word) > n)]


@dataclass
class Ordinal:
    """Feature weights and the rising thresholds between grades."""

    weights: dict[str, float]
    thresholds: np.ndarray

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))

    def chances(self, x: float) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - x, -60, 60)))


def fit(x: list[dict[int, float]], grades: np.ndarray, n_features: int, rounds: int = 800, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least penalised loss, by Adam on the whole bounded sample."""
    grades = np.asarray(grades, int)
    levels = max(1, int(grades.max(initial=0)))
    row = np.repeat(np.arange(len(x)), [len(d) for d in x])
    col = np.array([k for d in x for k in d], int)
    val = np.array([v for d in x for v in d.values()], float)
    chance = [np.clip((grades <= k).mean(), 1e-3, 1 - 1e-3) for k in range(levels)]
    start = np.log(np.array(chance) / (1 - np.array(chance)))
    p = np.concatenate([np.zeros(n_features), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    low, high = grades - 1, grades
    for step in range(1, rounds + 1):
        w, first, gaps = p[:n_features], p[n_features], np.exp(p[n_features + 1 :])
        theta = np.concatenate([[-np.inf], first + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        score = np.bincount(row, val * w[col], len(x))
        a, b = (1 / (1 + np.exp(-np.clip(theta[k + 1] - score, -60, 60))) for k in (low, high))
        inside = np.maximum(b - a, 1e-9)
        da, db = a * (1 - a) / inside, b * (1 - b) / inside  # slopes of the log-likelihood in either threshold
        by_score = -(db - da)
        by_theta = np.bincount(high, db, levels + 1)[:levels] - np.bincount(low + 1, da, levels + 1)[1 : levels + 1]
        tails = np.cumsum(by_theta[::-1])[::-1]
        g = np.concatenate([np.bincount(col, val * by_score[row], n_features) - ridge * w, tails[:1], tails[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w, first, gaps = p[:n_features], p[n_features], np.exp(p[n_features + 1 :])
    return w, first + np.concatenate([[0], np.cumsum(gaps)])


def train(
    df: DataFrame,
    labels: DataFrame,
    sample_docs: int = SAMPLE_DOCS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Ordinal:
    """Fits the model on labelled documents.

    Bounded: about ``sample_docs`` labelled rows, those with the least id hash, written down once. Labels are
    0 or 1; grades above 1 are derived from the evidence that a toxic document's words hold, so they order
    toxic documents but are no labels of their own. Null labels and labels without a document are left out;
    of several labels of one id the greatest counts; without toxic rows nothing is toxic. The driver gets the chosen features and,
    for each sampled row, its label, its evidence and its counts of those.
    """
    rated = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("_y"))
    size = max(1, rated.count())
    place = F.shiftrightunsigned(F.xxhash64(id_col), 11).cast("double") / float(1 << 53)
    sample = rated.where(place <= min(1.0, sample_docs / size))
    texts = df.where(place <= min(1.0, sample_docs / size)).select(id_col, text_col)
    known = cut(texts.join(sample, id_col).select(text_col, (F.col("_y") > 0).cast("int").alias("_y")))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, toxic, docs = Counter(), Counter(), [0, 0]

        def out() -> pa.RecordBatch:
            names = ["", *seen]
            return pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array([docs[0], *seen.values()]), pa.array([docs[1], *(toxic[f] for f in seen)])],
                names=["feature", "n", "bad"],
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    own = {f for w in words(text) for f in features(w)}
                    seen.update(own)
                    docs[0] += 1
                    if y:
                        toxic.update(own)
                        docs[1] += 1
                if len(seen) > 200_000:
                    yield out()
                    seen.clear(), toxic.clear()
                    docs[:] = 0, 0
        yield out()

    ship(df.sparkSession)
    counts = known.mapInArrow(partial, "feature string, n long, bad long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = counts.where("feature = ''").first()
    n, bad = (total["n"] or 0, total["bad"] or 0) if total else (0, 0)
    if not bad or bad == n:
        return Ordinal({}, np.array([-60.0 if n and bad == n else 60.0]))
    a, c = F.col("bad") + 0.5, F.col("n") - F.col("bad") + 0.5
    odds = F.log(a / c) - float(np.log(bad / (n - bad)))
    z = odds / F.sqrt(1 / a + 1 / c)
    kept = (
        counts.where((F.col("feature") != "") & (F.col("n") >= max(LEAST_DOCS, n * LEAST_SHARE)))
        .select("feature", odds.alias("odds"), z.alias("z"))
        .where((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS))
        .orderBy(F.desc("z"), "feature")
        .limit(FEATURES)
        .collect()
    )
    place_of = {r["feature"]: k for k, r in enumerate(kept)}
    shared = df.sparkSession.sparkContext.broadcast((place_of, [r["odds"] for r in kept]))
    schema = T.StructType(
        [
            T.StructField("y", T.IntegerType()),
            T.StructField("evidence", T.DoubleType()),
            T.StructField("f", T.ArrayType(T.IntegerType())),
        ]
    )

    def chosen(rows: dict[str, list]) -> dict[str, list]:
        get, strength = shared.value[0].get, shared.value[1]
        out: dict[str, list] = {"y": rows["_y"], "evidence": [], "f": []}
        for text in rows[text_col]:
            by_word = [[k for f in features(w) if (k := get(f)) is not None] for w in sorted(words(text))]
            out["evidence"].append(float(sum(max(strength[k] for k in ks) for ks in by_word if ks)))
            out["f"].append([k for ks in by_word for k in ks])
        return out

    rows = sorted(map_rows(known, schema, chosen).collect())  # sums of doubles depend on the order
    x = [dict(Counter(r["f"])) for r in rows]
    grades = np.array([1 + sum(r["evidence"] > limit for limit in GRADE_STEPS) if r["y"] else 0 for r in rows], int)
    w, thresholds = fit(x, grades, len(kept))
    return Ordinal({r["feature"]: float(v) for r, v in zip(kept, w, strict=True)}, thresholds)


def grade(df: DataFrame, model: Ordinal, limit: float = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, toxic, grade int, severity double) of every row.

    severity is the expected grade, the sum of P(grade > k); grade the most likely one; toxic whether
    severity reaches ``limit``. Null and empty texts have no features, so the least severity. Repeated rows
    give repeated results.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType(
        [
            T.StructField(id_col, df.schema[id_col].dataType),
            T.StructField("toxic", T.BooleanType()),
            T.StructField("grade", T.IntegerType()),
            T.StructField("severity", T.DoubleType()),
        ]
    )
    memo: dict[int, Bounded] = {}

    def each(rows: dict[str, list]) -> dict[str, list]:
        m = shared.value
        weight = memo.setdefault(0, Bounded(m.word_weight)) if m.weights else None
        scores = [sum(map(weight.__getitem__, sorted(words(t)))) if weight is not None else 0.0 for t in rows[text_col]]
        above = [m.chances(s) for s in scores]
        severity = [float(p.sum()) for p in above]
        likely = [int(np.argmax(np.append(1.0, p) - np.append(p, 0.0))) for p in above]
        return {"toxic": [s >= limit for s in severity], "grade": likely, "severity": severity}

    return map_rows(df.select(id_col, text_col), schema, each)
