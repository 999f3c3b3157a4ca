"""The pipeline against its operators' rules, and its behaviour on odd rows."""

from pyspark.sql import functions as F

import corpus_pipeline
from lexweave.llm import decontamination, language_id, sentencepiece_viterbi, toxicity
from lexweave.llm._common import table
from lexweave.llm.queries import tokenizer

from test_near_copies import kept


def test_each_stage_works_on_what_is_left(spark, sf_dir):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    labels, bench = table(spark, sf_dir, "labels"), table(spark, sf_dir, "benchmark")
    frame = lambda ids: table(spark, sf_dir, "documents").where("doc_id in (%s)" % ",".join(map(str, ids)))
    left = sorted(docs)
    model = toxicity.train(frame(left), labels)
    bad = lambda t: model.chances(sum(model.word_weight(w) for w in toxicity.words(t))).sum() >= toxicity.LIMIT
    left = [i for i in left if not bad(docs[i])]
    languages = language_id.train(frame(left))
    left = [i for i in left if languages.decide(docs[i])[0] != "und" and languages.decide(docs[i])[1] >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    left = sorted(kept({i: docs[i] for i in left}))
    items = decontamination.Items([tuple(r) for r in bench.select("item_id", "text").collect()])
    left = [i for i in left if not any(c >= decontamination.COVERAGE for _, c, _ in items.search(docs[i]))]
    codec = sentencepiece_viterbi.codec(tokenizer("piece_bpe_32k.model"))
    got = {r.doc_id: (r.n_pieces, r.restored) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {i: (len(codec.encode(docs[i])), True) for i in left}
    assert 0.5 * len(docs) < len(left) < len(docs)


def test_stages_keep_the_columns_and_take_odd_rows(spark, sf_dir):
    schema = table(spark, sf_dir, "documents").schema
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the one of them", None, "s", 3), (4, "the one of them", None, "s", 3), (4, "the one of them", None, "s", 3)]
    odd = spark.createDataFrame(rows, schema)
    clash = odd.withColumns({c: F.lit("clash") for c in ("row", "key", "toxic", "severity", "lang_pred", "matches", "contaminated", "class", "id")})
    for docs in (odd, odd.limit(0), clash):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns
            out.collect()
