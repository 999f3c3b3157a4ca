"""Near copies against brute force over all pairs."""

import collections
import random

import pyarrow as pa

import corpus_pipeline
from lexweave.llm import near_copies
from lexweave.llm._common import table


def sets(texts):
    words = {i: (t or "").lower().split() for i, t in texts.items()}
    return {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}


def kept(texts):
    """Smallest ids of the classes, by comparing all pairs."""
    s, owner = sets(texts), {i: i for i in texts}
    near = [(i, j) for i in s for j in s if i < j and 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j])]
    while True:
        before = dict(owner)
        for i, j in near:
            owner[i] = owner[j] = min(owner[i], owner[j])
        if owner == before:
            return {i for i in owner if owner[i] == i}


def test_the_stage_drops_all_near_copies_from_similarity_08(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect())
    assert got == sorted(kept({r.doc_id: r.text for r in docs.collect()}))


def test_edited_copies_chains_and_common_passages(spark, sf_dir):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(4))
    base, passage, texts = [word() for _ in range(120)], [word() for _ in range(40)], {}
    for i in range(90):
        if i % 3 == 0:  # copies at all distances, each an edit of the text before or of the first
            own = list(base)
            for _ in range(r.randint(0, 6)):
                own[r.randrange(len(own))] = word()
            base = own if r.random() < 0.5 else base
        else:
            own = [*passage, *(word() for _ in range(r.choice((4, 12, 60))))]
        texts[i] = " ".join(own)
    texts |= {90: "", 91: None, 92: "one two", 93: "One  two", 94: texts[1].upper()}
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], table(spark, sf_dir, "documents").schema)
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()}
    assert got == kept(texts)


def test_chains_over_batches_of_any_size():
    r = random.Random(1)
    for alone in (False, True):
        for _ in range(100):
            rows, batches = sorted((r.randint(0, 6), r.randint(0, 1), r.randint(0, 9)) for _ in range(r.randint(0, 40))), []
            at = 0
            while at < len(rows):
                part = rows[at : at + r.randint(1, 7)]
                at += len(part)
                batches.append(pa.RecordBatch.from_arrays([pa.array([x[k] for x in part]) for k in range(3)], names=["token", "part", "key"]))
            places = collections.defaultdict(list)
            for token, part, key in sorted(set(rows)):
                places[token, part].append(key)
            want = [(t, k, v[max(0, i - near_copies.CHAINED) : i]) for (t, _), v in places.items() for i, k in enumerate(v) if len(v) > 1 or alone]
            assert [tuple(x.values()) for out in near_copies._chained(iter(batches), alone) for x in out.to_pylist()] == want
