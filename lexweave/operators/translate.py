"""Batched translation with an injected client: the one step that calls out of Spark (O-60, O-82, O-90 to O-93)."""

from __future__ import annotations

import json
import random
import time
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import markup as M
from lexweave.functions.particles import polish
from lexweave.operators import inventory as I
from lexweave.shipping import ship

#: Statuses after which a call is worth repeating.
AGAIN = frozenset({408, 409, 429})
RESULT = "batch long, id long, answer string, tokens_in long, tokens_out long, error string"


class CallFailed(Exception):
    """A client's failed call; no status stands for a broken connection."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


def gate(template: Column, answer: Column) -> Column:
    """Why an answer is rejected, empty where it isn't: blank, or placeholders lost or added (O-91)."""
    lost = M.show_multiset(M.surplus(M.placeholders(template), M.placeholders(answer)))
    more = M.show_multiset(M.surplus(M.placeholders(answer), M.placeholders(template)))
    part = lambda word, s: F.when(s != "", F.concat(F.lit(f"{word} "), s))
    return F.when(M.blank(answer), "empty").otherwise(F.concat_ws(", ", part("lost", lost), part("added", more)))


def prompt(items: dict[int, str], terms: dict[str, str]) -> str:
    """Glossary lines in order, then the items as one JSON object (O-93)."""
    head = "".join(f"{k} = {v}\n" for k, v in sorted(terms.items()))
    return (f"Glossary:\n{head}\n" if head else "") + json.dumps({str(k): v for k, v in sorted(items.items())}, ensure_ascii=False)


def answers(text: str) -> dict[str, str] | None:
    """The JSON object inside a reply, None where there is none (O-41)."""
    try:
        found = json.loads(text[text.index("{") : text.rindex("}") + 1])
    except ValueError:
        return None
    return found if isinstance(found, dict) and all(isinstance(v, str) for v in found.values()) else None


def wait_before(attempt: int, jitter: Callable[[], float] = random.random) -> float:
    """Seconds before a repeated call: doubling up to a minute, and less than one more (O-92)."""
    return min(2.0**attempt, 60.0) + jitter()


def ask(client: Callable, text: str, retries: int = 5, sleep: Callable[[float], None] = time.sleep) -> tuple[dict, int, int, str]:
    """(answers, tokens in, tokens out, error): repeats calls that may yet succeed (O-92)."""
    used_in = used_out = 0
    error = ""
    for attempt in range(retries + 1):
        if attempt:
            sleep(wait_before(attempt - 1))
        try:
            reply, n_in, n_out = client(text)
            used_in, used_out = used_in + n_in, used_out + n_out
            found = answers(reply)
            if found is not None:
                return found, used_in, used_out, ""
            error = "no JSON object in the reply"
        except CallFailed as x:
            error = str(x)
            if x.status is not None and x.status not in AGAIN and x.status < 500:
                break
    return {}, used_in, used_out, error


def run(pending: DataFrame, client: Callable, glossary: dict[str, str] | None = None, batch: int = 40, retries: int = 5, concurrency: int = 4) -> DataFrame:
    """Pending units with answer, rejection, korean and the call's tokens (O-90).

    ``client(prompt)`` gives (reply, tokens in, tokens out) and runs on executors; each batch is one call
    and its failure leaves the batch untranslated, so what is done stays done. Write the result before
    reading it twice: a second read would call again.
    """
    ship(pending.sparkSession)
    size = max(1, batch)
    terms = glossary or {}
    cut = I.batches(pending, size).repartition(concurrency, "batch").sortWithinPartitions("batch", "id")

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def call() -> pd.DataFrame:
            items = {i: t for _, i, t in held}
            low = " ".join(items.values()).lower()
            wanted = {k: v for k, v in terms.items() if k.lower() in low}
            got, n_in, n_out, error = ask(client, prompt(items, wanted), retries)
            rows = [(b, i, got.get(str(i)), n_in if k == 0 else 0, n_out if k == 0 else 0, error) for k, (b, i, _) in enumerate(held)]
            return pd.DataFrame(rows, columns=["batch", "id", "answer", "tokens_in", "tokens_out", "error"])

        for frame in frames:
            for row in frame[["batch", "id", "template"]].itertuples(index=False):
                if held and held[0][0] != row.batch:
                    yield call()
                    held = []
                held.append(tuple(row))
        if held:
            yield call()

    said = cut.select("batch", "id", "template").mapInPandas(each, RESULT)
    rows = cut.join(said, ["batch", "id"])
    why = F.when(F.col("answer").isNull(), F.when(F.col("error") != "", F.col("error")).otherwise("no answer")).otherwise(gate(F.col("template"), F.col("answer")))
    rows = rows.withColumn("rejection", why)
    return rows.withColumn("korean", F.when(F.col("rejection") == "", polish(F.col("answer"))).otherwise(F.lit("")))


def rejections(done: DataFrame, n: int = 20) -> DataFrame:
    """The first rejected answers, by position (O-83)."""
    return done.where("rejection <> ''").select("pos", "template", "answer", "rejection").orderBy("pos").limit(n)


def placeholder_counts(text: str) -> Counter:
    """Placeholders of a template as a multiset, outside Spark."""
    import re

    return Counter(re.findall(M.PLACE, text))
