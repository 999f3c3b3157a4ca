"""Language identification with language-bitmask n-gram filters.

One Bloom filter serves all languages: each slot holds a bitmask of languages (bit slices side by side),
and the AND of an n-gram's slots gives every language that contains it. A text's hits are counted for each
language, corrected for that slice's false positives, and the most hits decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm._common import map_rows
from lexweave.shipping import ship

#: Documents of each language that training reads at most, on average; chosen by a hash of the id.
SAMPLE_DOCS = 2000
#: An n-gram is in a language if so large a share of its documents has it ...
LEAST_SHARE = 0.01
#: ... and at least so much of the largest share among languages (labels and passages can be foreign).
LEAST_RATIO = 0.3
#: Filter slots for each n-gram, and slots an n-gram sets.
SLOTS, HASHES = 16, 3
#: Characters that are turned into arrays at once.
CHUNK = 1 << 20
UNKNOWN = "und"
#: Multipliers that spread character codes over 64 bits.
ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def padded(text: str) -> str:
    return f" {text} ".lower()


def grams(low: str) -> np.ndarray:
    """64-bit codes of the trigrams around the letters of a padded text but its two ends; word edges count as blanks."""
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    c = np.where(letter, c, 32).astype(np.uint64)
    codes = c[:-2] * ODD[0] ^ (c[1:-1] * ODD[1] + (c[2:] * ODD[2]))
    return codes[letter[1:-1]]


def _slots(codes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for k in range(HASHES):
        h = (codes ^ (codes >> np.uint64(29 + k))) * ODD[k]
        yield (h >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Filter:
    """The filter (a row of masks for each 64 languages), its languages, and the false-positive rate of each slice."""

    languages: list[str]
    masks: np.ndarray
    false: np.ndarray
    #: What a text with letters but without any hit is taken for: the language with most documents.
    usual: str

    @classmethod
    def build(cls, languages: list[str], codes: np.ndarray, masks: np.ndarray, usual: str) -> Filter:
        bits = max(10, int(np.ceil(np.log2(max(1, len(codes)) * SLOTS))))
        masks = masks.reshape(len(codes), max(1, -(-len(languages) // 64)))
        table = np.zeros((masks.shape[1], 1 << bits), np.uint64)
        for slots in _slots(codes, bits):
            for k, slice_ in enumerate(table):
                np.bitwise_or.at(slice_, slots, masks[:, k])
        fill = np.array([((table[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))])
        return cls(languages, table, fill**HASHES, usual)

    def contains(self, codes: np.ndarray, part: int = 0) -> np.ndarray:
        """The bitmask of languages of each n-gram, for the 64 languages of one part."""
        bits = int(np.log2(self.masks.shape[1]))
        out = np.full(len(codes), np.uint64(2**64 - 1))
        for slots in _slots(codes, bits):
            out &= self.masks[part][slots]
        return out

    def decide(self, text: str | None) -> tuple[str, float]:
        if not text or not any(map(str.isalpha, text)) or not self.languages:
            return UNKNOWN, 0.0
        n, hits, low = 0, np.zeros(len(self.languages)), padded(text)
        for at in range(0, len(low) - 2, CHUNK):
            codes = grams(low[at : at + CHUNK + 2])  # chunks share two characters, so each trigram is in one
            n += len(codes)
            for part in range(len(self.masks)):
                kinds, counts = np.unique(self.contains(codes, part), return_counts=True)
                for k in range(64 * part, min(len(hits), 64 * part + 64)):
                    hits[k] += counts[(kinds >> np.uint64(k % 64)) & np.uint64(1) == 1].sum()
        true = np.clip((hits - n * self.false) / np.maximum(1 - self.false, 1e-9), 0, n)
        best = int(true.argmax())
        return (self.languages[best], float(true[best] / n)) if true[best] > 0 else (self.usual, 0.0)


def held_out(id_col: str) -> Column:
    """Whether a document is kept from training: one in five, by the CRC-32 of its id as text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train(
    df: DataFrame,
    sample_docs: int = SAMPLE_DOCS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Filter:
    """Learns the filter from rows that aren't held out and have a text and a language.

    Bounded: about ``sample_docs`` documents of each language, those with the least id hash. The driver gets counts by language and the chosen n-grams.
    """
    known = df.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = known.groupBy(lang_col).count().collect()
    counts = {r[0]: r[1] for r in sorted(sizes, key=lambda r: r[0])}
    if not counts:
        return Filter.build([], np.empty(0, np.uint64), np.empty(0, np.uint64), UNKNOWN)
    place = F.shiftrightunsigned(F.xxhash64(id_col), 11).cast("double") / float(1 << 53)
    rate = F.coalesce(*(F.when(F.col(lang_col) == k, F.lit(min(1.0, sample_docs / n))) for k, n in counts.items()))
    languages = list(counts)
    sample = known.where(place <= rate).select(lang_col, text_col)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                by: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    by.setdefault(lang, []).append(np.unique(grams(padded(text))))
                for lang, each in by.items():
                    codes, n = np.unique(np.concatenate(each), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(codes)), pa.array(codes.view(np.int64)), pa.array(n), pa.array([len(each)] + [0] * (len(codes) - 1))]
                        if len(codes)
                        else [pa.array([lang]), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([len(each)])],
                        names=["lang", "code", "n", "docs"],
                    )

    ship(df.sparkSession)
    found = sample.mapInArrow(partial, "lang string, code long, n long, docs long")
    docs = {r[0]: r[1] for r in found.groupBy("lang").agg(F.sum("docs")).collect()}
    share = F.coalesce(*(F.when(F.col("lang") == k, F.col("n") / F.lit(float(max(1, docs.get(k) or 1)))) for k in languages))
    place = F.coalesce(*(F.when(F.col("lang") == k, F.lit(i)) for i, k in enumerate(languages)))
    grouped = found.groupBy("lang", "code").agg(F.sum("n").alias("n")).where("n > 0")
    shares = grouped.select("code", place.alias("place"), share.alias("share"))
    top = shares.groupBy("code").agg(F.max("share").alias("top"), F.collect_list(F.struct("place", "share")).alias("each"))
    chosen = (
        top.where(F.col("top") >= LEAST_SHARE)
        .select(
            "code",
            F.transform(
                F.filter("each", lambda x: (x["share"] >= LEAST_SHARE) & (x["share"] >= LEAST_RATIO * F.col("top"))),
                lambda x: x["place"],
            ).alias("places"),
        )
        .collect()
    )
    codes = np.array([r[0] for r in chosen], np.int64).view(np.uint64)
    masks = np.zeros((len(chosen), -(-len(languages) // 64)), np.uint64)
    for k, (_, places) in enumerate(chosen):
        for i in places:
            masks[k, i // 64] |= np.uint64(1 << i % 64)
    return Filter.build(languages, codes, masks, max(languages, key=lambda k: counts[k]))


def predict(df: DataFrame, model: Filter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row, from the whole text alone, however long.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Equal counts go
    to the language first in alphabetical order. score is the share of n-grams that the language contains.
    Repeated rows give repeated results.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType(
        [
            T.StructField(id_col, df.schema[id_col].dataType),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def each(rows: dict[str, list]) -> dict[str, list]:
        got = [shared.value.decide(t) for t in rows[text_col]]
        return {"lang_pred": [a for a, _ in got], "score": [b for _, b in got]}

    return map_rows(df.select(id_col, text_col), schema, each)


def identify(df: DataFrame, model: Filter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row: ``predict``, and whether training left the row out."""
    return predict(df, model, id_col, text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
