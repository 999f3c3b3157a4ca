"""Whole results beyond sizes at which an operator changes its way of working, and for rows without a single id."""

import math
import random
import time

import pytest

import corpus_pipeline
from lexweave.llm import decontamination, html_text, language_id, queries, sentencepiece_viterbi, simhash, token_counts, toxicity
from lexweave.llm._common import table
from lexweave.llm.bpe_pairs import Bounded


def test_decontamination_gives_each_row_at_any_benchmark_size(spark, monkeypatch):
    items = [" ".join(f"w{k}x{j}" for j in range(12)) for k in range(9)]
    docs = spark.createDataFrame([(1, items[0]), (1, items[1]), (1, "clean"), (None, items[2]), (None, None), (2, " ".join(items[3:]))], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = lambda: sorted(map(str, decontamination.contamination(docs, bench).collect() + decontamination.matches(docs, bench).collect()))
    one = rows()
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 2)
    assert rows() == one and len(one) == 12


def test_every_language_is_learned(spark):
    letters = [chr(0x4E00 + k) for k in range(700)]
    docs = [(150 * k + j, " ".join("".join(letters[7 * k + (j + i) % 7] for i in range(n, n + 4)) for n in range(7)), f"l{k:03}", "s", 0) for k in range(100) for j in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, shard int")
    model = language_id.train(df)
    assert model.languages == [f"l{k:03}" for k in range(100)]
    want = {d[0]: d[2] for d in docs}
    assert all(r.lang_pred == want[r.doc_id] and r.score > 0.9 for r in language_id.identify(df, model).collect())


def test_verdicts_meet_rows_and_not_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    leak = table(spark, sf_dir, "benchmark").orderBy("item_id").first().text
    clean = docs.where("lang = 'en'").orderBy("doc_id").first()
    rows = [(None, leak, "en", "s", 0), (7, leak, "en", "s", 0), (7, clean.text, "en", "s", 0), (None, clean.text, "en", "s", 0)]
    got = corpus_pipeline.drop_contaminated(spark, spark.createDataFrame(rows, docs.schema), sf_dir).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("7", clean.text), ("None", clean.text)]
    strange = docs.unionByName(spark.createDataFrame([(None, "123 456", "en", "s", 0), (clean.doc_id, "123 456", "en", "s", 0)], docs.schema))
    got = corpus_pipeline.keep_known_languages(spark, strange, sf_dir).collect()
    assert not [r for r in got if r.text == "123 456"] and clean.text in {r.text for r in got}


RUNNING = "This is the text of the page and it is about what was said to the people who were there, and of all that they did in the town on that day with their friends."


def test_no_class_word_drops_what_holds_most_of_the_text():
    for mark in ("class='post has-sidebar comments-open'", "id=legal-history", "class=comments", "class='promo'"):
        for tag in ("article", "div"):
            assert html_text.extract(f"<nav>x</nav><{tag} {mark}><p>{RUNNING} A.</p><p>{RUNNING} B.</p></{tag}><footer>{RUNNING}</footer>") == f"{RUNNING} A.\n{RUNNING} B."
    page = f"<form><div><p>{RUNNING} A.</p></div></form><div class='user-comments'>{RUNNING}</div><p>{RUNNING} B.</p><p>{RUNNING} C.</p>"
    assert html_text.extract(page) == f"{RUNNING} B.\n{RUNNING} C."


def test_open_links_and_formulas():
    assert html_text.extract(f"<p>{RUNNING} <a href=x>more<p>{RUNNING} B.</p><p>{RUNNING} C.</p>") == f"{RUNNING} more\n{RUNNING} B.\n{RUNNING} C."
    assert html_text.extract(f"<article><p>{RUNNING} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> so.</p></article>") == f"{RUNNING} x=2 so."


def test_ties_of_neighbours_go_to_the_same_kind_of_element():
    links = "<ul><li><a href=x>one thing</a></li></ul>"
    assert html_text.extract(f"<p>{RUNNING}</p><p>Short.</p>{links}") == f"{RUNNING}\nShort."
    assert html_text.extract(f"<p>{RUNNING}</p><div>Short.</div>{links}") == RUNNING
    assert html_text.extract(f"{links}<h2>A title</h2><p>{RUNNING}</p>") == f"A title\n{RUNNING}"


def test_text_rules_alone_find_most_blocks_of_pages_without_marks(spark):
    import collections
    import re

    tp = given = wanted = 0
    for r in table(spark, "/root/testdata/sf0.01", "pages").collect():
        full = collections.Counter(html_text.extract(r.html).split("\n"))
        bare = collections.Counter(html_text.extract(re.sub(r"</?(article|main)[^>]*>", "", re.sub(r"\sclass=\"[^\"]*\"", "", r.html))).split("\n"))
        tp, given, wanted = tp + (full & bare).total(), given + bare.total(), wanted + full.total()
    assert 2 * tp / (given + wanted) >= 0.95


def test_a_teaser_article_does_not_hide_the_text_around_it():
    running = "This is the text of the page and it is about what was said to the people who were there, and of all that they did in the town on that day with their friends."
    page = f"<div><p>{running} One.</p><p>{running} Two.</p><p>{running} Three.</p></div><article><a href=x>Read on</a></article>"
    assert html_text.extract(page).split("\n") == [f"{running} {n}." for n in ("One", "Two", "Three")]


@pytest.mark.parametrize("name", ["blanks", "apostrophes", "newlines", "letters"])
def test_tokenizers_take_a_million_characters_without_a_word(name):
    import sentencepiece
    from tokenizers import Tokenizer

    r, n = random.Random(1), 1_000_000
    text = {"blanks": " " * n, "apostrophes": "'" * n, "newlines": "\n" * n, "letters": "".join(r.choice("abcdefgh") for _ in range(n))}[name]
    bpe, pieces = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model")
    counter, codec = token_counts.PrefixCounter(bpe), sentencepiece_viterbi.PieceCodec(pieces)
    began = time.perf_counter()
    count, cut, ids = counter.count(text), counter.fitting(text, 512), codec.encode(text)
    assert time.perf_counter() - began < 20
    library = Tokenizer.from_file(bpe)
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    assert count == size(text) and size(text[:cut]) <= 512 < size(text[: cut + 1])
    assert ids[:1000] == sentencepiece.SentencePieceProcessor(model_file=pieces).encode(text[:50_000])[:1000] and codec.decode(ids) == text
    assert len(counter.known) == len(codec.known) == 0


def test_memo_is_bounded_in_bytes():
    memo = Bounded(lambda k: k.encode() * 4, most=10_000)
    for k in range(500):
        assert memo[f"w{k}"] == f"w{k}".encode() * 4 and memo.held <= 10_000 and len(memo) <= 40
    assert memo["x" * 300] and "x" * 300 not in memo


def test_unigram_scores_decide():
    r = random.Random(2)
    codec = sentencepiece_viterbi.PieceCodec.__new__(sentencepiece_viterbi.PieceCodec)
    pieces = sorted({"".join(r.choice("abc▁") for _ in range(r.randint(1, 4))) for _ in range(40)} | {"a", "b", "▁"})
    codec.bytes = {b: 1000 + b for b in range(256)}
    codec._learn(pieces, {p: (i, -r.uniform(1, 9) * len(p) ** 0.5) for i, p in enumerate(pieces)}, 999, sentencepiece_viterbi.UNIGRAM, 1 << 20)
    for _ in range(300):
        text = "".join(r.choice("abcd▁é") for _ in range(r.randint(1, 60)))
        best = [(0.0, [])]
        for end in range(1, len(text) + 1):
            ways = [(best[a][0] + codec.weight[text[a:end]], [*best[a][1], text[a:end]]) for a in range(max(0, end - 4), end) if text[a:end] in codec.weight]
            if text[end - 1] not in codec.weight:
                ways.append((best[end - 1][0] + codec.unknown_weight, [*best[end - 1][1], text[end - 1]]))
            best.append(max(ways, key=lambda w: w[0]))
        assert list(codec.stream(text)) == [i for p in best[-1][1] for i in codec._ids_of(p)]


def test_model_types_are_told_apart(tmp_path):
    assert sentencepiece_viterbi.model_type(open(queries.tokenizer("piece_bpe_32k.model"), "rb").read()) == sentencepiece_viterbi.BPE
    assert sentencepiece_viterbi.model_type(b"\x12\x02\x18\x03") == 3 and sentencepiece_viterbi.model_type(b"") == sentencepiece_viterbi.UNIGRAM


def test_severity_is_the_models_own_arithmetic(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.unionByName(labels))  # repeated label rows change nothing
    assert model.weights == toxicity.train(docs, labels).weights and model.weights
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in toxicity.grade(docs, model).collect():
        found = {w for w in toxicity.WORD.findall(texts[r.doc_id].lower())}
        x = math.fsum(model.weights.get(f, 0.0) for w in found for f in [w, *(w[:n] + "-" for n in range(3, 9) if len(w) > n)])
        above = [1 / (1 + math.exp(min(60.0, max(-60.0, t - x)))) for t in model.thresholds]
        chances = [a - b for a, b in zip([1.0, *above], [*above, 0.0], strict=True)]
        assert math.isclose(r.severity, sum(above), abs_tol=1e-9) and r.toxic == (r.severity >= toxicity.LIMIT)
        assert math.isclose(chances[r.grade], max(chances), abs_tol=1e-9)


def test_language_score_is_the_filters_own_arithmetic(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in language_id.identify(docs.where("doc_id < 40"), model).collect():
        low = f" {texts[r.doc_id]} ".lower()
        codes = [language_id.grams("".join(c if c.isalpha() else " " for c in low[k - 1 : k + 2])) for k in range(1, len(low) - 1) if low[k].isalpha()]
        hits = [sum(int(model.contains(c)[0]) >> k & 1 for c in codes) for k in range(len(model.languages))]
        true = [min(len(codes), max(0.0, (h - len(codes) * f) / (1 - f))) for h, f in zip(hits, model.false.tolist(), strict=True)]
        best = true.index(max(true))
        assert r.lang_pred == model.languages[best] and math.isclose(r.score, true[best] / len(codes), abs_tol=1e-9)


def test_long_texts_have_no_edges(monkeypatch):
    import numpy as np

    r = random.Random(3)
    text = " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(400))
    codes = np.unique(language_id.grams(language_id.padded(text)))[::2]
    model = language_id.Filter.build(["x"], codes, np.ones(len(codes), np.uint64), "x")
    whole = model.decide(text)
    for size in (1, 2, 7, 100):
        monkeypatch.setattr(language_id, "CHUNK", size)
        assert model.decide(text) == whole


def test_components_equal_union_find(spark):
    """Chains, stars, loops, repeated edges and null ends, and random graphs of every density."""
    dice = random.Random(5)
    graphs = [[], [(1, 1)], [(1, 2), (1, 2)], [(5, None), (3, 2), (2, 3)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 300)] + [(300, 299)]]
    for _ in range(4):
        n = dice.randint(3, 400)
        graphs.append([(dice.randint(-n, n), dice.randint(-n, n)) for _ in range(dice.randint(1, n))])
    for edges in graphs:
        up: dict[int, int] = {}

        def root(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for u, v in edges:
            if v is not None and u != v:
                up.setdefault(u, u), up.setdefault(v, v)
                a, b = root(u), root(v)
                up[max(a, b)] = min(a, b)
        got = [tuple(r) for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()]
        assert sorted(got) == sorted((x, root(x)) for x in up)
