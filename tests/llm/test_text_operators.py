"""Language, quality, token counts, packing, scoring: against libraries, brute force or held-out rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from symweave.llm import language, masked_lm, packing, quality, token_count
from symweave.llm.common import id_bucket, table
from symweave.llm.language import ByteConvNet, op3_byte_cnn_language, windows_of
from symweave.llm.masked_lm import Scored, WindowNet, op2_masked_lm_score, tallied, windows
from symweave.llm.packing import op5_concat_cut_pack, pack
from symweave.llm.quality import isotonic, op10_rff_quality, statistics_of
from symweave.llm.token_count import Compiled, op6_fst_token_count, vocabulary_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(1)
    signs = [*"abcdefgh ABC   '''!!?.\n\t\r  srtevdml01234é日本ß 　🙂́", "<|endoftext|>", "'re", "'ll", " "]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["a" * 700, " " * 500, "'s's", "x\n\n\n", "!" * 333 + "hello " * 50, " a b", "a b "]


# ---- token counts ----------------------------------------------------------


def test_transducers_count_what_the_library_gives(library, odd_texts):
    got = Compiled(vocabulary_path()).counts(odd_texts)
    assert got.tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in odd_texts]


def test_compiled_part_may_be_dropped(library, odd_texts, monkeypatch):
    monkeypatch.setattr(token_count, "MAX_STATES", 50)
    ready = Compiled(vocabulary_path())
    for k in range(0, 300, 100):
        assert ready.counts(odd_texts[k : k + 100]).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in odd_texts[k : k + 100]]


def test_token_count_query(spark, sf_dir, library):
    texts = {r[0]: r[1] for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    got = op6_fst_token_count(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.over_limit, r.n_bytes) == (n, n > 512, len((texts[r.doc_id] or "").encode()))


def test_token_count_edges(odd_rows, no_rows):
    rows = {r.doc_id: r for r in token_count.count_tokens(odd_rows).collect()}
    assert rows[0].n_tokens == 0 and rows[0].n_bytes == 0 and rows[None].n_tokens == 2
    assert token_count.count_tokens(no_rows).count() == 0


# ---- packing ---------------------------------------------------------------


def check_packing(pieces, texts, library, window=1024):
    """Every id lies in one piece, pieces fill sequences without gaps, and only the last is short."""
    ids = [library.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    assert sum(p.length for p in pieces) == sum(map(len, ids))
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append(p)
    assert sorted(by) == list(range(len(by)))
    for s, ps in by.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == window or s == len(by) - 1 and at <= window


def test_packing_query(spark, sf_dir, library):
    docs = {r[0]: r[1] for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    pieces = op5_concat_cut_pack(spark, sf_dir).collect()
    check_packing(pieces, docs.values(), library)
    seen = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        ids = library.encode(docs[p.doc_id] or "", add_special_tokens=False).ids + [0]
        assert p.start == seen.get(p.doc_id, 0) and p.doc_tokens == len(ids)
        assert p.ids_crc32 == zlib.crc32(np.asarray(ids[p.start : p.start + p.length], "<u4").tobytes())
        seen[p.doc_id] = p.start + p.length


def test_packing_edges(odd_rows, no_rows, library):
    pieces = pack(odd_rows, window=64, with_ids=True).collect()
    check_packing(pieces, [r.text for r in odd_rows.collect()], library, 64)
    assert all(zlib.crc32(np.asarray(p.ids, "<u4").tobytes()) == p.ids_crc32 for p in pieces)
    assert pack(no_rows).count() == 0


def test_rank_encoder_equals_the_library(library, odd_texts):
    got = packing.Encoder(vocabulary_path(), *packing.profile(vocabulary_path())).encode([*odd_texts, None])
    assert got[-1] == b""
    assert [np.frombuffer(b, "<u2").tolist() for b in got[:-1]] == [library.encode(t, add_special_tokens=False).ids for t in odd_texts]


# ---- language --------------------------------------------------------------


def test_language_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    rows = op3_byte_cnn_language(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and held
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_tables_equal_a_plain_convolution():
    rng = np.random.default_rng(0)
    net = ByteConvNet(["a", "b", "c"])
    w, _, _ = windows_of([bytes(rng.integers(1, 255, 700, dtype=np.uint8)), b"short"])
    pooled = []
    for taps in net.taps:
        k = len(taps)
        h = np.stack([sum(taps[j][w[:, i + j]] for j in range(k)) for i in range(w.shape[1] - k + 1)])
        pooled.append(np.maximum(h.max(0), 0))
    logits = np.concatenate(pooled, 1) @ net.dense + net.bias
    p = np.exp(logits - logits.max(1, keepdims=True))
    assert np.allclose(net.probabilities(w), p / p.sum(1, keepdims=True), atol=1e-5)


def test_language_edges(spark, odd_rows, no_rows):
    net = language.train(odd_rows)
    got = {r.doc_id: r for r in language.identify(odd_rows, net).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2, 3, 7))
    assert got[4].lang_pred == "en"
    assert language.train(no_rows) is None
    assert {r.lang_pred for r in language.identify(odd_rows, None).collect()} == {"und"}
    kept = language.keep_identified(odd_rows, net)
    assert kept.columns == odd_rows.columns and kept.where("doc_id in (0, 1, 2, 3, 7)").count() == 0
    assert language.identify(no_rows, net).count() == 0


def test_language_never_sees_held_out_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    spoiled = docs.withColumn("lang", F.when(id_bucket("doc_id", 4) == 2, "wrong").otherwise(F.col("lang")))
    assert "wrong" not in language.train(spoiled.where(id_bucket("doc_id", 4) != 2)).labels


# ---- quality ---------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    rows = op10_rff_quality(spark, d).join(table(spark, d, "labels"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_isotonic_pools_violators():
    x, y = isotonic(np.array([0.0, 1, 2, 3]), np.array([5.0, 1, 2, 9]), np.array([10.0, 10, 10, 10]))
    assert (np.diff(y) >= 0).all() and x.tolist() == sorted(x.tolist())
    assert abs(y[0] - 8.5 / 31) < 1e-9 and abs(y[-1] - 9.5 / 11) < 1e-9


def test_statistics_read_the_whole_text():
    a, b = b"the word is here. " * 500, b"the word is here. " * 500 + b"### $$$ " * 500
    assert not np.allclose(statistics_of(a), statistics_of(b))
    assert np.isfinite(statistics_of(b"")).all() and np.isfinite(statistics_of(b" \n")).all()


def test_quality_edges(spark, odd_rows, no_rows):
    stats = quality.statistics(odd_rows)
    assert {r.score for r in quality.score(stats, None).collect()} == {0.5}
    one_class = stats.select("stats", F.lit(1).alias("label"), (F.col("doc_id") % 2 == 0).alias("calibrate")).where("calibrate is not null")
    assert all(0 <= r.score <= 1 for r in quality.score(stats, quality.fit(one_class)).collect())
    assert quality.fit(one_class.limit(0)) is None
    assert quality.score(quality.statistics(no_rows), None).count() == 0


# ---- masked scoring --------------------------------------------------------


def test_window_numbers():
    keys, ends = windows([b"abc", b"", b"z"])
    assert ends.tolist() == [3, 3, 4]
    parts = [[(int(k) >> s) & 255 for s in (32, 24, 16, 8, 0)] for k in keys]
    assert parts == [[0, 0, 97, 98, 99], [0, 97, 98, 99, 0], [97, 98, 99, 0, 0], [0, 0, 122, 0, 0]]


def test_window_counts_equal_brute_force(spark, odd_rows):
    texts = [(r.text or "").encode() for r in odd_rows.collect()]
    keys, counts = tallied(windows(texts)[0])
    got = {r.window: r.n for r in masked_lm.window_counts(odd_rows).collect()}
    assert got == dict(zip(keys.astype(np.int64).tolist(), counts.tolist(), strict=True))


def test_probabilities_sum_to_one():
    net = WindowNet()
    context = (np.uint64(97) << np.uint64(32)) | (np.uint64(98) << np.uint64(24)) | (np.uint64(99) << np.uint64(8))
    keys = np.asarray([context | (np.uint64(b) << np.uint64(16)) for b in range(256)], np.uint64)
    assert abs(np.exp(net.log_probabilities(keys)).sum() - 1) < 1e-4


def test_remembered_windows_score_alike():
    rng = np.random.default_rng(0)
    net, keys = WindowNet(), rng.integers(0, 1 << 40, 5000, dtype=np.uint64)
    small = Scored(net, 1 << 10)  # smaller than the keys: it is cleared again and again
    for part in (keys[:200], keys[:200], keys, keys[100:400]):
        assert np.allclose(small.of(part), net.log_probabilities(part), atol=1e-6)


def test_scores_are_summed_conditionals(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = masked_lm.train(masked_lm.window_counts(docs))
    texts = {r[0]: (r[1] or "").encode() for r in docs.collect()}
    rows = masked_lm.score(docs, net).collect()
    for r in rows[:40]:
        assert abs(r.log_likelihood - float(net.log_probabilities(windows([texts[r.doc_id]])[0]).sum(dtype=np.float64))) < 1e-2
    some = [t for t in texts.values() if len(t) > 500][:20]
    rng = np.random.default_rng(0)
    for t in some:  # a text is likelier than its own bytes in disorder
        mixed = bytes(rng.permutation(np.frombuffer(t, np.uint8)))
        assert net.log_probabilities(windows([t])[0]).mean() > net.log_probabilities(windows([mixed])[0]).mean() + 1


def test_scoring_edges(odd_rows, no_rows, spark, sf_dir):
    rows = {r.doc_id: r for r in masked_lm.score(odd_rows, WindowNet()).collect()}
    assert rows[0].n_tokens == 0 and rows[0].log_likelihood == 0 and rows[8].log_likelihood == rows[9].log_likelihood
    assert masked_lm.train(masked_lm.window_counts(no_rows)) is None
    assert op2_masked_lm_score(spark, sf_dir).count() == table(spark, sf_dir, "documents").count()


def test_the_faster_encoder_is_proven_and_a_wrong_file_is_not():
    import json

    from symweave.llm.packing import merged, profile, proven

    assert profile(vocabulary_path()) == (True, 2)
    with open(vocabulary_path(), encoding="utf-8") as f:
        model = json.load(f)
    merges = model["model"]["merges"]
    model["model"]["merges"] = [merges[1], merges[0], *merges[2:]]
    assert not proven(model)
    model["model"]["merges"] = merges
    model["pre_tokenizer"]["add_prefix_space"] = True
    assert not proven(model)
    assert merged(b"abc", {b"bc": 1, b"ab": 2, b"abc": 3}, 3) == [b"a", b"bc"]


def test_both_encoders_cut_every_code_point_alike():
    """Each code point beside a letter, a digit, a space and a sign: the class it has for either pattern shows in the ids."""
    from tokenizers import Tokenizer

    from symweave.llm.packing import Encoder

    own, library = Encoder(vocabulary_path(), True, 2), Tokenizer.from_file(vocabulary_path())
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b 1{chr(c)}2 {chr(c)}!{chr(c)}?\n" for c in points[at : at + 64]) for at in range(0, len(points), 64)]
    texts = [t for t in texts if not any(s in t for s in own.specials)]
    for a in range(0, len(texts), 1000):
        wanted = library.encode_batch(texts[a : a + 1000], add_special_tokens=False)
        assert [own.fast(t) for t in texts[a : a + 1000]] == [w.ids for w in wanted]


def test_quality_sums_and_features_by_hand(spark):
    """The ridge of partition sums equals a direct solution; statistics of a text equal plain counting."""
    import numpy as np

    from symweave.llm import quality

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, quality.WIDTH)).astype(np.float32)
    y = (x[:, 0] > 0).astype(int)
    rows = [(r.tolist(), int(v), i % 4 == 0) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "stats array<float>, label int, calibrate boolean").repartition(5)
    model = quality.fit(df, features=32)
    seen = np.asarray([i % 4 != 0 for i in range(300)])
    a = x[seen].astype(np.float64)
    assert np.allclose(model.mean, a.mean(0)) and np.allclose(model.scale, a.std(0) + 1e-6, atol=1e-5)
    z = np.hstack([np.sqrt(2 / 32) * np.cos(np.clip((a - a.mean(0)) / model.scale, -8, 8) @ model.frequencies + model.phase), np.ones((len(a), 1))])
    direct = np.linalg.solve(z.T @ z + quality.RIDGE * len(a) / 32 * np.eye(33), z.T @ y[seen])
    assert np.allclose(model.weights, direct, atol=1e-6)
    # where no label calibrates, or all do, there is a curve all the same
    for part in (df.where("not calibrate"), df.where("calibrate")):
        few = quality.fit(part, features=32)
        assert few.curve is not None and np.ptp(few.score(x)) > 0
    text = b"Aa bb, 12\n\nAa bb"
    s = quality.statistics_of(text)
    assert np.isclose(s[0], sum(c in b"abcdefghijklmnopqrstuvwxyz" for c in text) / len(text))
    k = len(quality.BYTE_CLASSES)
    assert np.isclose(s[k + 1], np.log1p(5)) and np.isclose(s[k + 6], 4 / 5) and np.isclose(s[k + 16], 0)


def test_masked_model_by_hand():
    """The network's probabilities against a plain forward pass, one window at a time."""
    import numpy as np

    from symweave.llm import masked_lm

    net = masked_lm.WindowNet(seed=9)
    text = "héllo".encode()
    keys, ends = masked_lm.windows([text])
    padded = b"\0" * masked_lm.SIDE + text + b"\0" * masked_lm.SIDE
    assert ends.tolist() == [len(text)]
    for i, got in enumerate(net.log_probabilities(keys)):
        around = [padded[i], padded[i + 1], padded[i + 3], padded[i + 4]]
        h = np.tanh(sum(net.tables[k][b] for k, b in enumerate(around)) + net.inner)
        p = np.exp(h @ net.out + net.bias)
        assert np.isclose(got, np.log(p[padded[i + 2]] / p.sum()), atol=1e-5)


def test_without_labels_no_document_is_rejected(odd_rows):
    from symweave.llm import language

    assert language.keep_identified(odd_rows, language.train(odd_rows.limit(0))).count() == odd_rows.count()


def test_batches_are_bounded_alike_by_every_operator(spark):
    from symweave.llm import common

    common.small_batches(spark)
    rows = spark.range(3).selectExpr("id", "repeat('x', 5000000) AS text").coalesce(1)
    sizes = rows.mapInArrow(lambda bs: (b.select([0]) for b in bs if b.num_rows <= 2), "id long").count()
    assert sizes == 3  # three texts of 5 MB never come in one batch
