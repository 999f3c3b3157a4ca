"""SentencePiece encoding and decoding by a streaming Viterbi search.

A path is a sequence of pieces and has the sum of their weights. A unigram model gives each piece its
score. BPE's merge order admits exactly those paths in which every two neighbours keep apart, so there
admissible paths have weight 0 and all others are cut. The search keeps the best path to each position of
a window no longer than the longest piece, and commits ids as soon as all paths that are still alive run
through one boundary. Output ids equal those of the sentencepiece library.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from math import inf

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexweave.llm._common import map_rows
from lexweave.llm.bpe_pairs import Bounded, Neighbours, merge_loop, split, trie

BLANK = "▁"


#: Model types as a .model file numbers them; no number stands for the first.
UNIGRAM, BPE = 1, 2
#: How far an unknown character's score lies below that of the worst piece.
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes):
    """(number, value) of a serialised message's fields: integers, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


def model_type(data: bytes) -> int:
    """The type that a model's trainer settings name."""
    trainer = next((v for n, v in _fields(data) if n == 2), b"")
    return next((v for n, v in _fields(trainer) if n == 3), UNIGRAM)


class PieceCodec:
    """Encodes and decodes with a BPE or unigram .model that has byte fallback and no text normalisation.

    Models of other types are refused. Ids of words are remembered in ``most`` bytes, about; words over
    256 characters aren't remembered.
    """

    def __init__(self, path: str, most: int = 128 << 20):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            kind = model_type(f.read())
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.bytes = {int(p[3:5], 16): i for i in range(n) if model.is_byte(i) and (p := model.id_to_piece(i))}
        if kind not in (UNIGRAM, BPE) or not self.bytes:
            raise ValueError("only BPE and unigram models with byte fallback are encoded")
        self._learn([model.id_to_piece(i) for i in range(n)], {model.id_to_piece(i): (i, model.get_score(i)) for i in plain}, model.unk_id(), kind, most)

    def _learn(self, pieces: list[str], plain: dict[str, tuple[int, float]], unknown: int, kind: int, most: int) -> None:
        """``plain``: piece -> (id, score) of the pieces that texts are made of."""
        self.pieces, self.unknown = pieces, unknown
        self.ids = {p: i for p, (i, _) in plain.items()}
        #: after[a][b]: whether b may follow a; None where all may. weight[b]: what b adds to a path; None where nothing does.
        self.after = self.weight = None
        if kind == BPE:
            order = {p: -score for p, (_, score) in plain.items()}
            rank = lambda a, b: order.get(a + b)
            made = {}
            for p in self.ids:
                if len(p) > 1:
                    last: list = []
                    if len(merge_loop(split(p), lambda a, b: rank(a, b) if a + b != p else last.append((a, b)))) == 2 and last:
                        made[p] = (order[p], *last[-1])
            neighbours = Neighbours(made, rank)
            self.after = neighbours.after
            usable = [p for p in self.ids if len(p) == 1 or (p in made and neighbours.whole(p))]
        else:
            usable = [*self.ids]
            self.weight = {p: score for p, (_, score) in plain.items()}
            self.unknown_weight = min(self.weight.values()) - UNKNOWN_PENALTY
        self.trie, self.longest = trie(usable), max(map(len, usable))
        #: No piece holds a blank behind another character, so a boundary before a run of blanks is final.
        self.by_word = not any(BLANK in p.lstrip(BLANK) for p in usable)
        self.chunks = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+" if self.by_word else "(?s).+")
        self.known = Bounded(lambda word: array("i", self.stream(word)).tobytes(), most)
        self.texts = [p.replace(BLANK, " ") if self.ids.get(p) == i else "" for i, p in enumerate(self.pieces)]
        self.byte_of = {i: b for b, i in self.bytes.items()}

    def _ids_of(self, piece: str) -> list[int]:
        got = self.ids.get(piece)
        if got is not None:
            return [got]
        return [self.bytes.get(b, self.unknown) for b in piece.encode()]

    def stream(self, text: str):
        """Yields the ids of a text whose blanks are marked, holding one window of it."""
        root, after, weight, widest = self.trie, self.after, self.weight, self.longest
        ends: dict[int, str] = {}  # boundary -> the last piece of the best path there
        total: dict[int, float] = {0: 0.0}  # boundary -> that path's weight, where paths have any
        done, size = 0, len(text)
        for start in range(size):
            left = ends.get(start)
            if start and left is None:
                continue
            if start - done > widest and start % widest == 0:  # paths may have met: commit what they share
                done = yield from self._commit(ends, done, start, min(size, start + widest))
                if weight is not None:
                    for p in [p for p in total if p < start]:
                        del total[p]
            fits = after[left] if left is not None and after is not None else None
            if text[start] not in root or weight is not None and None not in root[text[start]]:
                if weight is None:
                    ends.setdefault(start + 1, text[start])
                elif total[start] + self.unknown_weight > total.get(start + 1, -inf):
                    ends[start + 1], total[start + 1] = text[start], total[start] + self.unknown_weight
            node = root
            for end in range(start, min(size, start + widest)):
                node = node.get(text[end])
                if node is None:
                    break
                piece = node.get(None)
                if piece is None:
                    continue
                if weight is None:
                    if end + 1 not in ends and (fits is None or fits[piece]):
                        ends[end + 1] = piece
                elif total[start] + weight[piece] > total.get(end + 1, -inf):
                    ends[end + 1], total[end + 1] = piece, total[start] + weight[piece]
        if size:
            yield from self._path(ends, done, size)

    def _path(self, ends: dict[int, str], low: int, high: int):
        out, at = [], high
        while at > low:
            out.append(ends[at])
            at -= len(ends[at])
        for piece in reversed(out):
            yield from self._ids_of(piece)

    def _commit(self, ends: dict[int, str], done: int, start: int, reach: int):
        """Commits up to the last boundary that every path from ``start`` or beyond runs through."""
        alive = {p for p in ends if p >= start}
        while len(alive) > 1:
            top = max(alive)
            alive.remove(top)
            alive.add(top - len(ends[top]))
        meet = alive.pop()
        if meet > done:
            yield from self._path(ends, done, meet)
            for p in [p for p in ends if p < meet]:
                del ends[p]
            return meet
        return done

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian int32."""
        if not text:
            return b""
        return b"".join(map(self.known.__getitem__, self.chunks.findall(BLANK + text.replace(" ", BLANK))))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; runs of byte ids are read as UTF-8, with U+FFFD for what isn't."""
        texts, byte_of = self.texts, self.byte_of
        if byte_of.keys().isdisjoint(ids):
            out = "".join([texts[i] for i in ids])
        else:
            parts, held = [], bytearray()
            for i in ids:
                b = byte_of.get(i)
                if b is not None:
                    held.append(b)
                    continue
                if held:
                    parts.append(held.decode("utf-8", "replace"))
                    held.clear()
                parts.append(texts[i])
            parts.append(held.decode("utf-8", "replace"))
            out = "".join(parts)
        return out[1:] if out.startswith(" ") else out


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pieces array<int>) of every row; null text is empty and has no pieces."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("pieces", T.ArrayType(T.IntegerType()))])

    def each(rows: dict[str, list]) -> dict[str, list]:
        c = codec(path)
        return {"pieces": [np.frombuffer(c.encode_bytes(t or ""), np.int32) for t in rows[text_col]]}

    return map_rows(df.select(id_col, text_col), schema, each, rows=64)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", pieces_col: str = "pieces") -> DataFrame:
    """(id, text) of every row; null pieces give the empty text, unknown ids nothing."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def each(rows: dict[str, list]) -> dict[str, list]:
        c = codec(path)
        n = len(c.pieces)
        return {"text": [c.decode([i for i in p or [] if i is not None and 0 <= i < n]) for p in rows[pieces_col]]}

    return map_rows(df.select(id_col, pieces_col), schema, each, rows=64)


def digest(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pieces, pieces_xxh64, restored): encodes whole texts, decodes the ids and compares.

    pieces_xxh64 is the hex XXH64 (seed 0) of the ids as little-endian int32. restored tells whether
    decoding gave the text back; a literal U+2581 comes back as a blank, as in the library.
    """
    schema = T.StructType(
        [
            T.StructField(id_col, df.schema[id_col].dataType),
            T.StructField("n_pieces", T.LongType()),
            T.StructField("pieces_xxh64", T.StringType()),
            T.StructField("restored", T.BooleanType()),
        ]
    )

    def each(rows: dict[str, list]) -> dict[str, list]:
        c = codec(path)
        texts = [t or "" for t in rows[text_col]]
        ids = [c.encode_bytes(t) for t in texts]
        back = [c.decode(np.frombuffer(b, np.int32).tolist()) for b in ids]
        return {
            "n_pieces": [len(b) // 4 for b in ids],
            "pieces_xxh64": [xxhash.xxh64_hexdigest(b) for b in ids],
            "restored": [a == t for a, t in zip(back, texts, strict=True)],
        }

    return map_rows(df.select(id_col, text_col), schema, each, rows=64)
