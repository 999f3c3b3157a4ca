"""The ten operators against brute force, libraries, round trips and held-out labels, and on awkward rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexweave.llm import (
    chat_format,
    decontamination,
    html_text,
    language_id,
    mtree,
    queries,
    sentencepiece_viterbi,
    sharding,
    simhash,
    token_counts,
    toxicity,
)
from lexweave.llm._common import table

BPE, PIECES = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model")
#: Null and empty texts, ties, repeated rows, blanks only, a very long text; ``pieces`` and ``shard`` clash with results.
ODD = [
    (1, None, "en", "x", 1),
    (2, "", "en", "x", 1),
    (3, " \n\t ", None, "x", 1),
    (4, "the cat sat on the mat and was happy with it", "en", None, None),
    (5, "the cat sat on the mat and was happy with it", "en", "y", 2),
    (5, "the cat sat on the mat and was happy with it", "en", "y", 2),
    (6, "Ünïcode 😀 日本 <|endoftext|> ▁ it's we'll  2²", "de", "y", 2),
    (7, "word " * 60_000, "fr", "y", 2),
    (8, "a" * 30_000, "fr", "y", 2),
]
COLUMNS = "doc_id long, text string, lang string, source string, shard int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS).withColumn("n_tokens", F.lit("clash")).withColumn("fp", F.lit("clash"))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


def texts(seed, n=400):
    random.seed(seed)
    signs = [*"abdehint  \n\té1-_'日😀ﬁ２▁", "<s>", "the ", "ing", " wor", "   ", "<0x0A>", "<|endoftext|>", "'ll", "\x85", " "]
    return ["".join(random.choice(signs) for _ in range(random.randint(0, 25))) for _ in range(n)]


# 1


def test_token_counts_and_all_prefixes_equal_the_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(BPE), token_counts.PrefixCounter(BPE)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for t in texts(1):
        truth = [count(t[:n]) for n in range(len(t) + 1)]
        assert own.prefixes(t) == truth
        assert own.count(t) == truth[-1]
        for limit in (0, 2, 5):
            assert own.fitting(t, limit) == max(n for n, c in enumerate(truth) if c <= limit)


def test_token_counts_rows(spark, odd, nothing):
    rows = token_counts.count_tokens(odd, BPE).collect()
    assert len(rows) == len(ODD) and token_counts.count_tokens(nothing, BPE).count() == 0
    by = {r.doc_id: r for r in rows}
    assert (by[1].n_bytes, by[1].n_tokens, by[1].over_limit) == (0, 0, False) == (by[2].n_bytes, by[2].n_tokens, by[2].over_limit)
    assert by[7].over_limit and by[7].n_tokens >= 60_000 and 0 < by[7].limit_chars < 300_000
    assert [len(r.prefix_tokens) for r in token_counts.prefix_tables(odd.where("doc_id = 4"), BPE).collect()] == [45]


# 2


def plain_simhash(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    values = sorted(fps.items())
    label = {i: i for i, _ in values}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, (i, x) in enumerate(values):
        for j, y in values[:k]:
            if (x ^ y).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {i: find(i) for i in label}


def test_fingerprints(odd):
    for r in simhash.fingerprints(odd).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        if r.doc_id < 7:
            assert r.fp % 2**64 == plain_simhash(r.text)


def test_near_duplicates_of_documents(spark, sf_dir):
    fps = {r.doc_id: int(r.fingerprint, 16) for r in queries.op2_simhash(spark, sf_dir).collect()}
    own = {r.doc_id: plain_simhash(r.text) for r in table(spark, sf_dir, "documents").collect()}
    assert fps == own
    assert {r.doc_id: r.component_id for r in queries.op2_simhash(spark, sf_dir).collect()} == brute_components(own)


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_dense_ball_is_dealt_in_blocks(spark, block_rows):
    random.seed(3)
    centre = random.getrandbits(64)
    flip = lambda n: sum(1 << b for b in random.sample(range(64), n))
    fps = list({centre ^ flip(random.randint(0, 3)) for _ in range(150)} | {random.getrandbits(64) for _ in range(40)} | {centre ^ flip(9) for _ in range(40)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame(list(enumerate(signed)), "node long, fp long")
    got = {r.node: r.component for r in simhash.components(simhash.links(nodes, block_rows=block_rows)).collect()}
    want = brute_components(dict(enumerate(fps)))
    assert {i: got.get(i, i) for i in want} == want


def test_large_run_keeps_every_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 30, dtype=np.int64).view(np.uint64)
    fps = np.unique(np.concatenate([base ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for b, c in rng.integers(0, 63, (40, 2))]))
    tables = np.array([[(int(x) ^ p).bit_count() for p in simhash.pivots()] for x in fps], np.int16)
    got = simhash._large_run(fps, tables, 4, tile=16)
    want = brute_components({i: int(x) for i, x in enumerate(fps)})
    groups = lambda labels: {frozenset(np.flatnonzero(np.array(labels) == v)) for v in set(labels)}
    assert groups(got.tolist()) == groups([want[i] for i in range(len(fps))])


def test_long_chain_is_one_component(spark):
    edges = spark.range(60).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.component for r in simhash.components(edges).collect()} == {0}


def test_near_duplicate_rows(spark, odd, nothing):
    by = {r.doc_id: r.component_id for r in simhash.near_duplicates(odd).collect()}
    assert by[1] == by[2] == by[3] == 1 and by[4] == by[5] == 4
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.dedup(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 6, 7, 8]


# 3


def plain_tiles(item, text, least):
    """Greedy tiling by its definition: the longest common run of unmarked words, again and again."""
    a_marked, b_marked, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for a in range(len(item)):
            for b in range(len(text)):
                n = 0
                while a + n < len(item) and b + n < len(text) and item[a + n] == text[b + n] and a + n not in a_marked and b + n not in b_marked:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < least:
            return total
        a_marked |= set(range(a, a + n))
        b_marked |= set(range(b, b + n))
        total += n


def test_tiles_equal_plain_greedy_tiling():
    random.seed(4)
    for _ in range(120):
        item = [random.randint(0, 30) for _ in range(random.randint(3, 24))]
        parts = [item[i : i + random.randint(2, 9)] for i in random.sample(range(len(item)), 2)]
        text = [99, *parts[1], 98, *parts[0], 97, *item[:6]]
        tiles = decontamination.tile(item, text, 3)
        assert sum(n for _, _, n in tiles) == plain_tiles(item, text, 3)
        for a, b, n in tiles:
            assert item[a : a + n] == text[b : b + n]


def test_tiles_of_small_alphabets_equal_plain_greedy_tiling():
    random.seed(12)
    item, text = [1, 0, 0, 1, 1, 0, 0, 1, 1, 1, 1, 1, 1, 1], [0, 0, 1, 1, 0, 1, 1, 1, 1, 1, 2, 0, 2, 0, 0, 1, 0, 0, 0, 1, 2, 1, 1, 2]
    assert sorted(n for _, _, n in decontamination.tile(item, text, 3)) == [4, 6]
    for _ in range(3000):
        letters = random.randint(1, 3)
        item = [random.randint(0, letters) for _ in range(random.randint(3, 16))]
        text = [random.randint(0, letters) for _ in range(random.randint(3, 24))]
        tiles = decontamination.tile(item, text, 3)
        assert sum(n for _, _, n in tiles) == plain_tiles(item, text, 3)
        assert len({k for a, _, n in tiles for k in range(a, a + n)}) == len({k for _, b, n in tiles for k in range(b, b + n)}) == sum(n for _, _, n in tiles)


def test_reordered_passages_are_caught_and_clean_texts_left(spark, odd, nothing):
    words = [f"w{k}" for k in range(40)]
    moved = " ".join([*"said he that".split(), *words[20:], "and", *words[:20], "so"])
    docs = spark.createDataFrame([(1, moved), (2, " ".join(words[:10])), (3, "nothing of it here at all"), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(words)), (8, "too short item"), (7, None), (None, "no id of any sort here")], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.item_ids) for r in decontamination.contamination(docs, bench).collect()}
    assert got == {1: (True, [9]), 2: (False, []), 3: (False, []), 4: (False, [])}
    assert decontamination.contamination(odd, bench).count() == len(ODD)
    assert decontamination.contamination(nothing, bench).count() == 0
    assert decontamination.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_of_documents_equals_containment(spark, sf_dir):
    norm = decontamination.words
    items = {r.item_id: norm(r.text) for r in table(spark, sf_dir, "benchmark").collect()}
    want = {}
    for r in table(spark, sf_dir, "documents").collect():
        text = f" {' '.join(norm(r.text))} "
        want[r.doc_id] = sorted(i for i, w in items.items() if f" {' '.join(w)} " in text)
    got = {r.doc_id: r.item_ids for r in queries.op3_decontamination(spark, sf_dir).collect()}
    assert got == want and any(want.values())


# 4


def plain_shard(doc_id, shards):
    ask = lambda s: -math.log((int(hashlib.md5(f"{doc_id}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13)
    return min(range(shards), key=ask)


def test_sharding_of_documents(spark, sf_dir):
    rows = queries.op4_rendezvous_sharding(spark, sf_dir).collect()
    docs = {r.doc_id: (r.text or "").encode() for r in table(spark, sf_dir, "documents").collect()}
    slots = {}
    for r in sorted(rows, key=lambda r: (hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id)):
        assert (r.shard, r.grown_shard) == (plain_shard(r.doc_id, 8), plain_shard(r.doc_id, 9))
        assert r.size == len(docs[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id])
        assert r.slot == slots.setdefault(r.shard, 0) and r.grown_shard in (r.shard, 8)
        slots[r.shard] += 1
    assert len(rows) == len(docs)


def test_sharding_rows_and_weights(spark, odd, nothing):
    rows = sharding.assign(odd).collect()
    assert len(rows) == len(ODD) and sharding.assign(nothing).count() == 0
    assert {r["size"] for r in rows if r.doc_id in (1, 2)} == {1}
    ids = spark.range(4000).select(sharding.rendezvous(F.col("id"), {"a": 1.0, "b": 3.0}).alias("s"), sharding.rendezvous(F.col("id"), {"a": 1.0, "b": 4.0}).alias("t")).collect()
    assert abs(sum(r.s == "b" for r in ids) / 4000 - 0.75) < 0.03
    assert not any(r.s == "b" and r.t == "a" for r in ids)


# 5


def test_language_accuracy_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op5_language_id(spark, sf).collect()}
    docs = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out and docs[i].lang]
    assert sum(got[i].lang_pred == docs[i].lang for i in held) >= 0.98 * len(held)


def test_filter_never_misses_a_language_and_corrects_false_hits():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2**63, 5000, dtype=np.int64).view(np.uint64)
    masks = np.array([1 << (k % 3) for k in range(5000)], np.uint64)
    f = language_id.Filter.build(["a", "b", "c"], codes, masks, "a")
    assert (f.contains(codes) & masks == masks).all()
    other = rng.integers(0, 2**63, 50_000, dtype=np.int64).view(np.uint64)
    rate = (f.contains(other) & np.uint64(1)).mean()
    assert abs(rate - f.false[0]) < 0.002


def test_language_rows(spark, odd, nothing):
    model = language_id.train(odd)
    by = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(odd, model).collect()}
    assert by[1] == by[2] == by[3] == ("und", 0.0) and by[4][0] == "en"
    assert language_id.identify(nothing, language_id.train(nothing)).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd, language_id.train(nothing)).collect()} == {"und"}


# 6


def test_chat_rows_and_round_trip(spark):
    said = "</s>[INST] ok [/INST] &lt;| <|turn|> &amp; <|done|> <"
    rows = [(1, 2, "assistant", said), (1, 1, "user", None), (1, 1, None, "x"), (2, None, "assistant", ""), (2, None, "assistant", ""), (3, 1, "us<|says|>er", "y"), (None, 1, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = chat_format.format_chats(df.withColumn("parts", chat_format.text_part(F.col("text"))))
    got = {r.conv_id: [(t.role, t.text) for t in r.t] for r in out.select("conv_id", chat_format.parse(F.col("formatted")).alias("t")).collect()}
    assert got == {1: [("", "x"), ("user", ""), ("assistant", said)], 2: [("assistant", "")] * 2, 3: [("us<|says|>er", "y")], None: [("user", "z")]}
    one = {r.conv_id: r for r in chat_format.digest(out).collect()}[1]
    assert one.loss_chars == len(said) and one.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert one.turns_sha256 == hashlib.sha256(f"\nx\nuser\n\nassistant\n{said}\n".encode()).hexdigest()
    assert chat_format.format_chats(df.limit(0).withColumn("parts", chat_format.text_part(F.col("text")))).count() == 0


def test_typed_parts_become_ordered_placeholders(spark):
    part = "struct<type:string,text:string,ref:string,tokens:long>"
    rows = [
        (1, 1, "user", [("text", "see ", None, None), ("image", None, "a.png", None), ("audio", None, "b.wav", 7)]),
        (1, 2, "assistant", [("text", "a ", None, None), ("document", None, "c.pdf", None), ("text", "b", None, None)]),
        (1, 3, "user", None),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")
    r = chat_format.format_chats(df).first()
    assert r.formatted == "<|turn|>user<|says|>see <|image:1|><|audio:2|><|done|><|turn|>assistant<|says|>a <|document:3|>b<|done|><|turn|>user<|says|><|done|>"
    assert [tuple(a) for a in r.attachments] == [(1, "image", "a.png", 256), (2, "audio", "b.wav", 7), (3, "document", "c.pdf", 512)]
    assert r.attachment_tokens == 775
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == ["a <|document:3|>b"]


# 7


def test_ordinal_fit_finds_order_and_weights():
    rng = np.random.default_rng(2)
    strength = rng.integers(0, 6, 600)
    x = [{0: float(s), 1: float(rng.integers(0, 3))} for s in strength]
    grades = np.array([0 if s < 2 else 1 if s < 4 else 2 for s in strength])
    w, t = toxicity.fit(x, grades, 2)
    assert w[0] > 3 * abs(w[1]) and t[0] < t[1]
    model = toxicity.Ordinal({}, t)
    assert [round(model.chances(w[0] * s).sum()) for s in (0, 3, 5)] == [0, 1, 2]


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").join(labels.select("doc_id"), "doc_id", "left_semi")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 0
    model = toxicity.train(docs, labels.where(~part))
    rows = toxicity.grade(docs.where(part), model).join(labels.withColumnRenamed("toxic", "y"), "doc_id").collect()
    right = sum(r.toxic == bool(r.y) for r in rows) / len(rows)
    caught = sum(r.toxic for r in rows if r.y) / max(1, sum(r.y for r in rows))
    false = sum(r.toxic for r in rows if not r.y) / sum(not r.y for r in rows)
    assert right >= 0.97 and caught >= 0.8 and false <= 0.005


def test_toxicity_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(k, k % 2, None if k == 3 else int(k == 4)) for k in range(9)], "doc_id long, quality int, toxic int")
    assert toxicity.grade(odd, toxicity.train(odd, labels)).count() == len(ODD)
    none = toxicity.train(nothing, labels.limit(0))
    assert toxicity.grade(odd, none).where("toxic").count() == 0 and toxicity.grade(nothing, none).count() == 0


# 8


def test_pieces_equal_the_library():
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepiece_viterbi.PieceCodec(PIECES)
    random.seed(6)
    longs = ["".join(random.choice("abcdefinthe▁ ") for _ in range(3000)) for _ in range(3)] + ["a" * 5000]
    for t in [*texts(7, 800), *longs]:
        ids = library.encode(t)
        assert own.encode(t) == ids
        assert own.decode(ids) == library.decode(ids)


def test_stream_holds_a_window():
    own = sentencepiece_viterbi.PieceCodec(PIECES)
    random.seed(8)
    stream = own.stream("▁" + "".join(random.choice("abcdefinthe") for _ in range(20_000)))
    first = [next(stream) for _ in range(10)]
    held = len(stream.gi_frame.f_locals["ends"])
    assert first and held <= 8 * own.longest


def test_piece_rows(spark, odd, nothing):
    rows = {r.doc_id: r for r in sentencepiece_viterbi.digest(odd, PIECES).collect()}
    assert rows[1].n_pieces == rows[2].n_pieces == 0 and all(r.restored for i, r in rows.items() if i != 6)
    back = sentencepiece_viterbi.decode(sentencepiece_viterbi.encode(odd, PIECES), PIECES)
    plain = {r.doc_id: (r.text or "").replace("▁", " ") for r in odd.collect()}
    assert all(r.text == plain[r.doc_id] for r in back.collect())
    assert sentencepiece_viterbi.digest(nothing, PIECES).count() == 0


# 9


def test_main_text_leaves_the_rest():
    running = "This is the text of the page and it is about what was said to the people who were there, and of all that they did in the town on that day with their friends."
    page = f"""<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>
      <div class="cookie-notice">{running}</div><h2>A heading</h2><p>{running}</p><p>Short one.</p><p>{running} &amp; more&nbsp;x</p>
      <div id=sidebar>{running}</div><form>{running}</form><script>var a = "<p>no</p>";</script><section class="comments">{running}</section>
      <footer>{running}</footer></body></html>"""
    assert html_text.extract(page).split("\n") == ["A heading", running, "Short one.", f"{running} & more x"]
    assert html_text.extract(f"<nav><ul><li>x<article><h1>T</h1><p>Wee.<p>{running}<aside>{running}</aside></article>y") == f"T\nWee.\n{running}"
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<p") == ""
    assert html_text.extract("<article><p>a < b & c\n\n d<br>e</article>") == "a < b & c d e"


def test_pages_equal_the_article(spark):
    import re
    from html import unescape

    sf = "/root/testdata/sf0.01"
    html = {r.page_id: r.html for r in table(spark, sf, "pages").collect()}
    for r in queries.op9_html_text(spark, sf).collect():
        inner = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1].replace("<br>", " ")
        lines = (re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]+>", "", p))).strip() for p in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text)


def test_page_rows(spark):
    df = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "<p>" + "deep <div>" * 20_000)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert [r.text for r in html_text.main_texts(df).where("page_id = 1").collect()] == ["", ""]
    assert html_text.main_texts(df.limit(0)).count() == 0


# 10


def brute_top(vectors, k=5, every=50):
    out = []
    for q, v in vectors:
        if q % every == 0:
            scored = sorted((-(v @ w), i) for i, w in vectors if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def test_top_k_equals_brute_force_with_ties_and_copies(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.integers(-3, 3, 4).astype(float) / 256) for i in range(600)] + [(i, np.full(4, 2 / 256)) for i in range(600, 700)]
    bad = [(800, None), (850, [1.0, None, 1.0, 1.0]), (900, [math.inf] * 4), (950, [math.nan] * 4), (None, [0.0] * 4)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows] + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    vectors = mtree.quantised(df)
    want = brute_top([(i, np.floor(v.astype(np.float32).astype(float) * 256).astype(int)) for i, v in rows])
    for size in (10, 150, 32_768):
        assert sorted(map(tuple, mtree.top_k(vectors, vectors.where("id % 50 = 0"), 5, tree_rows=size).collect())) == want
    assert mtree.top_k(vectors.limit(0), vectors.limit(0), 5).count() == 0
    few = vectors.where("id < 3")
    assert sorted(map(tuple, mtree.top_k(few, few.where("id = 0"), 5).select("query_id", "rank").collect())) == [(0, 1), (0, 2)]


def test_top_k_of_large_ragged_and_repeated_vectors(spark):
    rng = np.random.default_rng(11)
    wide = [(i, rng.normal(size=3) * 10.0 ** rng.integers(-2, 9)) for i in range(120)]
    other = [(i, rng.normal(size=2 + i % 2)) for i in range(200, 260)] + [(300, np.array([3e5, 1.0])), (350, np.empty(0)), (400, np.array([1e200, -1e200, 1e200]))]
    rows = [*wide, *other, wide[7], wide[100]]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    exact = [(i, [math.floor(x * 256) for x in v]) for i, v in rows]
    want = []
    for q, v in dict(exact[:-2]).items():
        if q % 50 == 0:
            scored = sorted((-mtree.clamped(sum(a * b for a, b in zip(v, w, strict=True))), i) for i, w in exact if i != q and len(w) == len(v))[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    vectors = mtree.quantised(df)
    for size in (20, 32_768):
        assert sorted(map(tuple, mtree.top_k(vectors, vectors.where("id % 50 = 0"), 5, tree_rows=size).collect())) == sorted(want)


def test_tree_avoids_distance_computations():
    rng = np.random.default_rng(10)
    centres = rng.integers(-2000, 2000, (40, 8))
    vectors = np.concatenate([c + rng.integers(-20, 20, (200, 8)) for c in centres])
    tree = mtree.Tree(np.arange(len(vectors)), vectors, 6)
    asked = list(range(0, 400, 40))
    for q, found in zip(asked, tree.search(asked, vectors[asked].astype(float), 5), strict=True):
        assert [s for s, _ in found] == sorted((vectors @ vectors[q])[np.arange(len(vectors)) != q].tolist(), reverse=True)[:5]
    assert tree.computed < 0.3 * 10 * len(vectors)
