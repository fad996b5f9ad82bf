"""The pipeline's stages against brute-force versions of their decisions."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from symweave.llm import decontaminate, simhash
from symweave.llm.common import materialise, table
from test_other_operators import brute_hits
from test_text_operators import check_packing


@pytest.fixture(scope="module")
def stages(spark):
    d = "/root/testdata/sf0.01"
    docs, out = table(spark, d, "documents"), []
    for name, f in corpus_pipeline.STAGES:
        docs = materialise(f(spark, docs, d), name)
        out.append((name, docs))
    return d, out


def test_columns_pass_through(spark, stages):
    d, out = stages
    want = table(spark, d, "documents").columns
    assert [n for n, _ in out] == ["language_id", "near_dedup", "decontaminate", "surrogates", "pack"]
    assert all(x.columns == want for _, x in out[:-1])


def test_language_keeps_clean_documents(spark, stages):
    d, out = stages
    assert out[0][1].count() >= 0.99 * table(spark, d, "documents").where(F.col("text").rlike(r"\p{L}")).count()


def test_one_document_of_each_copy_stays(spark, stages):
    _, out = stages
    before, after = out[0][1].collect(), out[1][1].collect()
    texts = {}
    for r in before:
        texts.setdefault(r.text, []).append(r.doc_id)
    kept = {r.doc_id for r in after}
    assert all(sum(i in kept for i in ids) <= 1 for ids in texts.values())
    groups = {r.doc_id: r.component for r in simhash.copies(out[0][1]).collect()}
    assert kept == {i for i, c in groups.items() if i == c}


def test_benchmark_windows_are_gone(spark, stages):
    d, out = stages
    items = [(k, decontaminate.words_of(t)) for k, t in decontaminate.benchmark_items(table(spark, d, "benchmark"))]
    before = {r.doc_id: r.text for r in out[1][1].collect()}
    after = {r.doc_id: r.text for r in out[2][1].collect()}
    cut = 0
    for i, t in before.items():
        words = decontaminate.words_of(t.encode())
        hit, _ = brute_hits(words, items)
        if not hit:
            assert after[i] == t
        elif len(hit) > 0.5 * len(words):
            assert i not in after
        else:
            assert decontaminate.words_of(after[i].encode()) == [w for p, w in enumerate(words) if p not in hit]
            cut += 1
    assert cut


def test_packed_ids_are_those_of_the_last_texts(spark, stages):
    from tokenizers import Tokenizer

    from symweave.llm.token_count import vocabulary_path

    _, out = stages
    check_packing(out[4][1].collect(), [r.text for r in out[3][1].collect()], Tokenizer.from_file(vocabulary_path()))


def test_run_gives_the_pieces(spark, stages):
    d, out = stages
    assert corpus_pipeline.run(spark, d).count() == out[4][1].count()


def test_stages_stand_odd_rows(spark, odd_rows, no_rows, sf_dir):
    wanted = ["doc_id", "text", "lang", "source", "n_chars"]
    for rows in (odd_rows, no_rows):
        docs = rows.select(*wanted, F.lit(1).alias("component"), F.lit("x").alias("m"))
        for name, f in corpus_pipeline.STAGES:
            docs = materialise(f(spark, docs, sf_dir), name)
        docs.count()
