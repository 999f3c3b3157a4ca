"""Korean particle pairs, settled by the character before them (O-36, O-37, O-94)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions.markup import bound

# Particles after a final consonant and after a vowel, how a pair is written, how digits are read.
PAIRS = (("으로", "로"), ("을", "를"), ("은", "는"), ("이", "가"), ("과", "와"))
CANONICAL = {"으로": "으로(로)", "을": "을(를)", "은": "은(는)", "이": "이(가)", "과": "와(과)"}
DIGITS = dict(zip("0123456789", "영일이삼사오육칠팔구", strict=True))
#: Characters that start a particle of either kind.
STARTS = tuple((c[0], v[0]) for c, v in PAIRS)
PAIR = "(?:" + "|".join(rf"(?:{c}|{v})\((?:{c}|{v})" for c, v in PAIRS) + r")\)"


def _settle(before: Column, pair: Column) -> Column:
    # a digit is judged by how it is read
    last = F.translate(F.substring(before, -1, 1), "".join(DIGITS), "".join(DIGITS.values()))

    def choose(at: Column) -> Column:
        final = at["code"] % 28
        out = None
        for (after_consonant, after_vowel), starts in zip(PAIRS, STARTS, strict=True):
            drops = final.isin(0, 8) if after_consonant == "으로" else final == 0
            hangul = (at["code"] >= 0) & (at["code"] <= 0xD7A3 - 0xAC00)
            choice = F.when(~hangul, CANONICAL[after_consonant]).when(drops, after_vowel).otherwise(after_consonant)
            mine = at["kind"].isin(*starts)
            out = F.when(mine, choice) if out is None else out.when(mine, choice)
        return out

    return bound(F.struct((F.ascii(last) - 0xAC00).alias("code"), F.left(pair, F.lit(1)).alias("kind")), choose)


def fix_particles(v: Column) -> Column:
    """Collapses particle pairs; what stands before a pair may itself have been settled, so this is a fold."""
    found = F.regexp_extract_all(v, F.lit(PAIR), F.lit(0))

    def settled(between: Column) -> Column:
        steps = F.transform(found, lambda m, k: F.struct(m.alias("pair"), F.get(between, k + 1).alias("text")))
        return F.aggregate(steps, F.get(between, F.lit(0)), lambda acc, s: F.concat(acc, _settle(acc, s["pair"]), s["text"]))

    return bound(F.split(v, PAIR, -1), settled)


polish = fix_particles
