"""Which tokens may stand side by side in the output of byte-pair encoding.

A sequence of tokens is the encoding of its text exactly if every two neighbours encode to themselves.
So the last token of every prefix is unique, and a left-to-right programme over prefixes finds the same
tokens as the merge loop, in time linear in the text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import inf


def merge_loop(symbols: Sequence, rank: Callable) -> list:
    """Byte-pair encoding by its definition: merges the pair of least rank, leftmost first.

    ``rank(a, b)`` is None where a and b don't merge. Quadratic; for single tokens and for tests.
    """
    parts = list(symbols)
    while len(parts) > 1:
        ranked = [(r, i) for i in range(len(parts) - 1) if (r := rank(parts[i], parts[i + 1])) is not None]
        if not ranked:
            break
        at = min(ranked)[1]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Bounded(dict):
    """A memo of ``make`` for texts, which forgets everything once keys and answers take ``most`` bytes, about.

    Texts longer than ``longest`` are answered anew each time, so one of them never fills it.
    """

    def __init__(self, make: Callable, most: int = 64 << 20, longest: int = 256):
        super().__init__()
        self.make, self.most, self.longest, self.held = make, most, longest, 0

    def __missing__(self, key):
        got = self.make(key)
        if len(key) > self.longest:
            return got
        # four bytes a character at most, and what Python adds to two objects and an entry
        self.held += 4 * len(key) + (len(got) if isinstance(got, bytes) else 0) + 250
        if self.held > self.most:
            self.clear()
            self.held = 0
        self[key] = got
        return got


class _Rows(dict):
    def __init__(self, ask: Callable, most: int):
        super().__init__()
        self.ask, self.most, self.held = ask, most, 0

    def __missing__(self, a):
        row = self[a] = _Row(self, a)
        return row


class _Row(dict):
    def __init__(self, rows: _Rows, a):
        super().__init__()
        self.rows, self.a = rows, a

    def __missing__(self, b):
        rows = self.rows
        if rows.held >= rows.most:
            rows.clear()
            rows.held = 0
        rows.held += 1
        got = self[b] = rows.ask(self.a, b)
        return got


def split(token) -> list:
    """A token's smallest symbols: single bytes, or single characters of a str."""
    return [token[i : i + 1] for i in range(len(token))]


def trie(tokens) -> dict:
    """Nested dicts by symbol; a token itself stands under the key None of its node."""
    root: dict = {}
    for token in tokens:
        node = root
        for symbol in token:
            node = node.setdefault(symbol, {})
        node[None] = token
    return root


class Neighbours:
    """Tells whether the token b may follow the token a.

    ``made``: token -> (rank of the merge that makes it, its left part, its right part); tokens without
    an entry are smallest symbols. ``rank``: pair -> rank of its merge or None.
    """

    def __init__(self, made: dict, rank: Callable, most: int = 600_000):
        self.made, self.rank = made, rank
        #: after[a][b]: whether b may follow a. Holds ``most`` answers and a row of slack.
        self.after = _Rows(self.apart, most)

    def apart(self, a, b, until: float = inf) -> bool:
        """Whether no merge of a rank under ``until`` crosses the boundary of a and b.

        Goes back in time: takes apart whichever neighbour was made later (of two made by one rule, the
        right one), and asks at each step whether the symbols then at the boundary would have merged first.
        """
        made, rank = self.made, self.rank
        while True:
            r = rank(a, b)
            if r is not None and r < until:
                return False
            x, y = made.get(a), made.get(b)
            if x and (not y or x[0] > y[0]):
                until, a = x[0], x[2]
            elif y:
                until, b = y[0] + 1, y[1]
            else:
                return True

    def whole(self, token) -> bool:
        """Whether the merge loop makes this token of its smallest symbols."""
        got = self.made.get(token)
        return not got or (self.whole(got[1]) and self.whole(got[2]) and self.apart(got[1], got[2], got[0]))
