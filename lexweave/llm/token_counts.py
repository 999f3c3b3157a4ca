"""Token counts by dynamic programming over prefixes.

For every prefix of a text the table holds the exact number of tokens that the tokenizer would give for
that prefix alone, so truncation and budget questions need no second encoding. The tokenizer is a
byte-level BPE given as a ``tokenizers`` JSON file.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexweave.llm._common import map_rows
from lexweave.llm.bpe_pairs import Bounded, Neighbours, trie

# Unicode's white space, and the word pattern of the byte-level tokenizer.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = " ?[{L}]+|'(?:[stmd]|re|ve|ll)| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
# Letters and numbers among the characters that FAST allows.
LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SLOW_ONLY = re.compile("[^\x00-ɏ‐-‧‰-⁞]")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable Latin-1 stands for itself."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Counts tokens of texts and of their prefixes, in time linear in the text.

    Counts of words are remembered in ``most`` bytes, about; words over 256 characters aren't remembered.
    """

    def __init__(self, path: str, most: int = 128 << 20):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        pairs = [(as_bytes(a), as_bytes(b)) for a, b in pairs]
        ranks = {pair: k for k, pair in enumerate(pairs)}
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        rank = lambda a, b, get=ranks.get: get((a, b))
        self.neighbours = Neighbours({a + b: (k, a, b) for k, (a, b) in reversed([*enumerate(pairs)])}, rank)
        self.trie = trie({bytes([b]) for b in range(256)} | {*filter(self.neighbours.whole, self.neighbours.made)})
        self.longest = max(map(len, self.neighbours.made), default=1)
        self.fast = re.compile(PATTERN.format(L=LATIN, N=DIGITS, S=SPACE))
        self.any = regex.compile(PATTERN.format(L=r"\p{L}", N=r"\p{N}", S=SPACE))
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.known = Bounded(lambda word: self.table(word.encode())[-1], most)

    def table(self, word: bytes) -> list[int]:
        """Token counts at each byte prefix of one word, from the empty one on.

        Exactly one token can end the encoding of a prefix: the one that may follow what ends where it starts.
        """
        root, after, size = self.trie, self.neighbours.after, len(word)
        last: list = [None] * (size + 1)
        count = [0] * (size + 1)
        for start in range(size):
            fits = after[last[start]] if start else None
            node, tokens = root, count[start] + 1
            for end in range(start, size):
                node = node.get(word[end])
                if node is None:
                    break
                token = node.get(None)
                if token is not None and last[end + 1] is None and (fits is None or fits[token]):
                    last[end + 1], count[end + 1] = token, tokens
        return count

    def words(self, text: str) -> list[str]:
        return (self.any if SLOW_ONLY.search(text) else self.fast).findall(text)

    def pieces(self, text: str) -> list[str]:
        """Words and special strings, in order."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.words(text)
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text)):
            out += [part] if k % 2 else self.words(part)
        return out

    def _count(self, piece: str) -> int:
        return 1 if piece in self.special else self.known[piece]

    def count(self, text: str) -> int:
        """Tokens of the whole text: the last entry of its prefix table."""
        return sum(map(self._count if any(s in text for s in self.special) else self.known.__getitem__, self.pieces(text)))

    def _tail(self, pieces: list[str], k: int) -> int:
        """First piece whose tokens a cut inside piece k can change.

        White space before it joins what is left of it, and a broken special string is plain text that
        joins the word before it.
        """
        if k and pieces[k] in self.special and pieces[k - 1] not in self.special:
            k -= 1
        while k and pieces[k - 1].isspace():
            k -= 1
        return k

    def prefixes(self, text: str) -> list[int]:
        """Token count of each prefix text[:0], text[:1], ... taken alone."""
        pieces = self.pieces(text)
        before = [0, *accumulate(map(self._count, pieces))]
        starts = [0, *accumulate(map(len, pieces))]
        out = [0]
        for k in range(len(pieces)):
            out += self._inside(text, pieces, before, starts, k)
        return out

    def _inside(self, text: str, pieces: list[str], before: list[int], starts: list[int], k: int, most: int | None = None) -> list[int]:
        """Counts of the prefixes that end 1, 2, ... (up to ``most``) characters into piece k: one table gives them all."""
        piece, tail = pieces[k], self._tail(pieces, k)
        if piece in self.special or piece[0] == "'" and len(piece) > 1 and piece[1].isalpha():
            # a short piece that falls apart when it is cut
            cuts = (text[starts[tail] : starts[k] + n] for n in range(1, len(piece) + 1))
            return [before[tail] + sum(map(self._count, self.pieces(rest))) for rest in cuts]

        def at(word: str, first: int) -> list[int]:
            word = word if most is None else word[: first + most]
            counts = self.table(word.encode())
            return [counts[b] for b in list(accumulate(len(c.encode()) for c in word))[first:]]

        if piece[0].isspace() and tail < k or piece.isspace():
            # a prefix that ends in white space ends with all of the run as one word
            run = text[starts[tail] : starts[k]] + (piece if piece.isspace() else piece[0])
            out = [before[tail] + n for n in at(run, starts[k] - starts[tail])]
            return out if piece.isspace() else out + [before[k] + n for n in at(piece, 1)]
        return [before[k] + n for n in at(piece, 0)]

    def fitting(self, text: str, limit: int) -> int:
        """Characters of the longest prefix of at most ``limit`` tokens."""
        pieces = self.pieces(text)
        before = [0, *accumulate(map(self._count, pieces))]
        if before[-1] <= limit:
            return len(text)
        starts = [0, *accumulate(map(len, pieces))]
        k = min(bisect_right(before, limit), len(pieces) - 1)
        while k + 1 < len(pieces) and before[self._tail(pieces, k + 1)] <= limit:
            k += 1
        for at in range(k, -1, -1):
            # no token has more bytes than the longest, so longer prefixes have too many
            counts = self._inside(text, pieces, before, starts, at, (limit - before[self._tail(pieces, at)] + 1) * self.longest)
            for n in range(len(counts), 0, -1):
                if counts[n - 1] <= limit:
                    return starts[at] + n
        return 0


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(
    df: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, limit_chars) of every row.

    Null text counts as empty: no bytes, no tokens. limit_chars is how many characters of the text
    fit into ``limit`` tokens. Time is linear in the text, also for long runs without a word's end. Repeated rows give repeated results; other columns are not read.
    """
    id_type = df.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField(id_col, id_type),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
            T.StructField("limit_chars", T.LongType()),
        ]
    )

    def each(rows: dict[str, list]) -> dict[str, list]:
        c = counter(path)
        texts = [t or "" for t in rows[text_col]]
        counts = [c.count(t) for t in texts]
        return {
            "n_bytes": [len(t.encode()) for t in texts],
            "n_tokens": counts,
            "over_limit": [n > limit for n in counts],
            "limit_chars": [c.fitting(t, limit) if n > limit else len(t) for t, n in zip(texts, counts, strict=True)],
        }

    return map_rows(df.select(id_col, text_col), schema, each)


def prefix_tables(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, prefix_tokens array<int>): the exact token count at every character prefix.

    Entry i belongs to the first i characters. Null text is empty and has the one entry 0.
    """
    schema = T.StructType(
        [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("prefix_tokens", T.ArrayType(T.IntegerType()))]
    )

    def each(rows: dict[str, list]) -> dict[str, list]:
        return {"prefix_tokens": [counter(path).prefixes(t or "") for t in rows[text_col]]}

    return map_rows(df.select(id_col, text_col), schema, each, rows=32)
