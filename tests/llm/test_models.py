from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

import corpus_pipeline
from lexmill.llm import quality, toxicity
from lexmill.llm._words import hash_words, shingles
from lexmill.llm.quality import estimate_prior, op9_nonneg_pu_quality, quality_scores
from lexmill.llm.sentencepieces import MODEL, Encoder, decode_ids, encode_texts, parse_model
from lexmill.llm.toxicity import drop_toxic, op6_conv_toxicity, toxicity_scores

LARGE = "/root/testdata/sf0.1"


def test_words_are_hashed_alike_in_any_chunk(monkeypatch):
    from lexmill.llm import _words

    texts = pa.array(["a b c d e f", "A B c d E f", None, "", "one two", "x", " lead a b c d e", "one two", "e" * 50])
    bounds, (words, heads) = hash_words(texts, heads=(3,))
    assert list(np.diff(bounds)) == [6, 6, 0, 0, 2, 1, 6, 2, 1] and (words[:6] == words[6:12]).all() and len(heads) == len(words)
    offsets, runs = shingles(bounds, words)
    assert list(np.diff(offsets)) == [2, 2, 0, 0, 1, 1, 2, 1, 1] and (runs[:2] == runs[2:4]).all()
    for chunk in (1, 2, 7, 16):
        monkeypatch.setattr(_words, "CHUNK", chunk)
        again, (same, same_heads) = hash_words(texts, heads=(3,))
        assert (again == bounds).all() and (same == words).all() and (same_heads == heads).all()


def test_ids_equal_the_original(docs):
    original = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [r["text"] for r in docs.collect()] + ["", " ", "  a", "a  b\n\n c ", "<s>x</s><unk>", "▁▁x", "日本 😀", *["x" + " " * k + "y" for k in range(40)]]
    encode = Encoder(MODEL, 2, True)
    ids, trips, same = encode(texts)
    assert ids.to_pylist() == original.encode(texts) and same.all()
    assert all(t or "▁" in text for t, text in zip(trips, texts, strict=True))
    encode.by_word = False
    assert encode(texts)[0].to_pylist() == ids.to_pylist()


def test_model_file_is_parsed():
    model = parse_model(open(MODEL, "rb").read())
    original = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert len(model.pieces) == original.vocab_size() and model.byte_fallback
    assert all(model.pieces[i][0] == original.id_to_piece(i) and abs(model.pieces[i][1] - original.get_score(i)) < 1e-6 for i in range(0, 32000, 97))


def test_encoding_of_odd_rows(odd, none):
    got = encode_texts(odd)
    assert got.count() == odd.count() and encode_texts(none).count() == 0 and got.where("not parity or not round_trip").count() == 0
    back = {(r["doc_id"], r["text"]) for r in decode_ids(got).collect()}
    assert back == {(r["doc_id"], r["text"] or "") for r in odd.collect()}


@pytest.mark.parametrize(("query", "column", "folds", "held", "recall", "precision"), [(op6_conv_toxicity, "toxic", 3, 1, 0.75, 0.9), (op9_nonneg_pu_quality, "quality", 4, 2, 0.95, 0.95)])
def test_held_out_recall_and_precision(spark, query, column, folds, held, recall, precision):
    import zlib

    truth = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{LARGE}/labels.parquet").collect()}
    rows = query(spark, LARGE).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    judged = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    hits = sum(a and b for a, b in judged)
    assert hits >= recall * sum(b for _, b in judged) and hits >= precision * sum(a for a, _ in judged)


@pytest.mark.parametrize("query", [op6_conv_toxicity, op9_nonneg_pu_quality])
def test_scores_repeat(spark, sf_dir, query):
    assert sorted(map(tuple, query(spark, sf_dir).collect())) == sorted(map(tuple, query(spark, sf_dir).collect()))


def random_model(rng):
    model = toxicity.Classifier(
        rng.normal(0, 1, (4, toxicity.ROWS, toxicity.DIM)),
        [rng.normal(0, 1, (w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS],
        [rng.normal(0, 1, toxicity.FILTERS) for _ in toxicity.WIDTHS],
        rng.normal(0, 0.3, len(toxicity.WIDTHS) * toxicity.FILTERS),
        0.1,
    )
    return model, toxicity.hashed(pa.array(["a b c d e f g", "one", "", "two words", "b c d a a b one two three"]))


def test_convolution_equals_a_slow_one():
    model, texts = random_model(np.random.default_rng(4))
    best, where = model.pooled(texts, places=True)
    for i, (lo, hi) in enumerate(zip(texts.bounds[:-1], texts.bounds[1:], strict=True)):
        words = [sum(model.tables[k][texts.rows[k][w]] for k in range(4)) for w in range(lo, hi)]
        for k, width in enumerate(toxicity.WIDTHS):
            for c in range(toxicity.FILTERS):
                found = [sum(words[a + j] @ model.filters[k][j, :, c] for j in range(width)) + model.biases[k][c] for a in range(len(words) - width + 1)]
                want = max([0.0, *found])
                assert abs(best[i, k * toxicity.FILTERS + c] - want) < 1e-4
                assert where[i, k * toxicity.FILTERS + c] == (lo + int(np.argmax(found)) if want > 0 else -1)


def test_gradients_equal_differences():
    rng = np.random.default_rng(5)
    model, texts = random_model(rng)
    y, share, keep = np.array([1, 0, 1, 0, 1]), rng.random(5), rng.random((5, len(model.weights))) > 0.2
    loss = lambda: toxicity.gradients(model, texts, y, share, keep)[0]
    _, grads, changes = toxicity.gradients(model, texts, y, share, keep)

    def slope(array, at, step=1e-3):
        array[at] += step
        up = loss()
        array[at] -= 2 * step
        down = loss()
        array[at] += step
        return (up - down) / (2 * step)

    for array, grad in zip([*model.filters, *model.biases, model.weights], grads[:-1], strict=True):
        for at in [tuple(rng.integers(0, n) for n in array.shape) for _ in range(12)]:
            assert abs(slope(array, at) - grad[at]) < 2e-3 * max(1, abs(grad[at]))
    table = np.zeros_like(model.tables)
    for i, rows, change in changes:
        np.add.at(table[i], rows, change)
    for k in range(4):
        for row in rng.choice(texts.rows[k], 6):
            assert abs(slope(model.tables, (k, row, 3)) - table[k, row, 3]) < 2e-3 * max(1, abs(table[k, row, 3]))


def test_descent_follows_the_risk():
    rng = np.random.default_rng(6)
    for prior in (0.2, 0.7):
        z = rng.normal(0, 2, 60)
        split = lambda z: (1 / (1 + np.exp(-z[:20])), 1 / (1 + np.exp(-z[20:])))
        for shift in (0.0, -6.0):  # far below, the unlabelled look negative and the second part falls under zero
            now = z + np.where(np.arange(60) < 20, -shift, shift)
            plus, minus = quality.risk(*split(now), prior)
            assert (minus < 0) == (shift < 0)
            direct = prior * np.log1p(np.exp(-now[:20])).mean(), np.log1p(np.exp(now[20:])).mean() - prior * np.log1p(np.exp(now[:20])).mean()
            assert abs(plus - direct[0]) < 1e-6 and abs(minus - direct[1]) < 1e-5
            aim = (lambda z: sum(quality.risk(*split(z), prior))) if minus >= 0 else (lambda z: -quality.risk(*split(z), prior)[1])
            back = quality.descent(*split(now), prior)
            for i in (0, 7, 25, 59):
                up, down = now.copy(), now.copy()
                up[i], down[i] = up[i] + 1e-4, down[i] - 1e-4
                assert abs((aim(up) - aim(down)) / 2e-4 - back[i]) < 1e-5


def test_long_words_are_hashed_in_pieces():
    texts = pa.array(["a " + "x" * 3_000_000 + " b", "x" * 3_000_000, "x" * 2_999_999 + "y", None, "x" * 3_000_000])
    bounds, (words, heads) = hash_words(texts, heads=(4,))
    assert list(np.diff(bounds)) == [3, 1, 1, 0, 1] and words[1] == words[3] == words[5] != words[4]
    assert heads[1] == heads[3] == heads[4] == hash_words(pa.array(["xxxx"]), heads=(4,))[1][1][0]


def test_a_repeated_id_gives_one_text(spark):
    from lexmill.llm._labels import texts_of

    docs = spark.createDataFrame([(1, f"t{i}", "en") for i in range(50)] + [(2, "x", None)], "doc_id long, text string, lang string")
    ids = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, label int")
    assert sorted(map(tuple, texts_of(docs, ids, 100).collect())) == [(1, 1, "t0", "en"), (2, 0, "x", None)]


def test_a_table_without_languages(docs, labels):
    bare = docs.drop("lang")
    kept = drop_toxic(bare, labels)
    assert kept.columns == bare.columns and 0 < kept.count() <= bare.count()
    assert toxicity_scores(bare, labels).where(f"cut = {toxicity.CUT}").count() == bare.count()


def test_held_out_labels_are_never_read(spark, docs, labels):
    """Scores stay the same when the labels of the held-out rows are turned round."""
    from pyspark.sql import functions as F

    from lexmill.llm._labels import fold

    for scores, column, folds, held in ((toxicity_scores, "toxic", 3, 1), (quality_scores, "quality", 4, 2)):
        turned = labels.withColumn(column, F.when(fold(F.col("doc_id"), folds) == held, 1 - F.col(column)).otherwise(F.col(column)))
        a = {r["doc_id"]: r["score"] for r in scores(docs, labels).collect()}
        assert a == {r["doc_id"]: r["score"] for r in scores(docs, turned).collect()}


def test_prior_of_known_mixtures():
    rng = np.random.default_rng(1)
    for prior in (0.3, 0.6, 0.9):
        pos = rng.normal(3, 1, 4000)
        unl = np.where(rng.random(4000) < prior, rng.normal(3, 1, 4000), rng.normal(-2, 1, 4000))
        assert abs(estimate_prior(pos, unl) - prior) < 0.06


def test_non_negative_risk_separates():
    rng = np.random.default_rng(2)
    pos = rng.normal(1.5, 1, (500, 5))
    unl = np.concatenate((rng.normal(1.5, 1, (700, 5)), rng.normal(-1.5, 1, (300, 5))))
    net = quality.train(pos, unl)
    assert 0.6 < net.prior < 0.8
    assert (net.score(rng.normal(1.5, 1, (300, 5))) >= 0.5).mean() > 0.95 and (net.score(rng.normal(-1.5, 1, (300, 5))) < 0.5).mean() > 0.95


def test_scores_of_odd_rows(spark, odd, none, labels):
    for scores in (toxicity_scores, quality_scores):
        assert scores(odd, labels).where("score between 0 and 1").count() == odd.count()
        assert scores(odd, labels.limit(0)).count() == odd.count() and scores(none, labels).count() == 0
        got = {r["score"] for r in scores(odd, labels).where("doc_id in (3, 4)").collect()}
        assert len(got) == 1  # null and empty texts score alike
    kept = drop_toxic(odd, labels)
    assert kept.dtypes == odd.dtypes and kept.count() == odd.count() and drop_toxic(none, labels).count() == 0


def test_a_word_decides(spark):
    """One word marks a text; the filters find it wherever it stands, in a language each."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        words = [f"w{n}" for n in rng.integers(0, 400, 60)]
        bad = i % 3 == 0
        if bad:
            words[int(rng.integers(0, 60))] = ("foul", "vile")[i % 2]
        rows.append((i, " ".join(words), ("en", "de")[i % 2], int(bad)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    got = {r["doc_id"]: r for r in toxicity_scores(frame, frame.select("doc_id", "toxic")).collect()}
    assert np.mean([got[i]["toxic"] == bool(t) for i, _, _, t in rows]) > 0.97
    assert toxicity.LOWEST_CUT <= min(r["cut"] for r in got.values()) <= max(r["cut"] for r in got.values()) <= toxicity.HIGHEST_CUT


def test_pipeline_equals_its_stages(spark, sf_dir, docs):
    """Each stage against what its operator says about the stage's own input."""
    from lexmill.llm.near_dedup import near_duplicates
    from lexmill.llm.secrets import find_in, mask
    from lexmill.llm.source_mix import mix_sources

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.cut(stage(spark, now, sf_dir), "test-stage")
        seen.append((name, now, after))
        now = after
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, f) = seen
    low = {r["doc_id"] for r in toxicity_scores(a, labels).where("score < 0.7 and not toxic").select("doc_id").collect()}
    assert {r["doc_id"] for r in b.collect()} == low
    assert {r["doc_id"] for r in c.collect()} == {r["doc_id"] for r in near_duplicates(b).where("kept").collect()}
    assert {(r["doc_id"], r["text"]) for r in d.collect()} == {(r["doc_id"], mask(r["text"], find_in(r["text"]))) for r in c.collect()}
    want = {r["doc_id"]: min(2, math.ceil(r["taken"] / r["size"])) for r in mix_sources(d).where("size > 0").collect()}
    got: dict[int, int] = {}
    for r in e.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {i: n for i, n in want.items() if n}
    assert all(x.columns == docs.columns for x in (b, c, d, e)) and f.count() == e.count() == corpus_pipeline.run(spark, sf_dir).count()


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_of_odd_rows(spark, sf_dir, odd, empty, tmp_path):
    """Nulls, empty and very long texts, repeated rows and ids, names that operators use and names with dots; and none of them."""
    from pyspark.sql import functions as F

    from lexmill.llm.near_dedup import near_duplicates
    from lexmill.llm.secrets import find_in, mask

    extra = ["_gone", "_doc", "_id", "row", "copies", "n", "text_at", "a.b", "c0", "c1", "rank", "place", "range", "follows"]
    secret = spark.createDataFrame([(11, "password = hunter2hunter2 and more", "en", "a"), (12, "token: abcdefgh12345", None, None)], "doc_id long, text string, lang string, source string")
    rows = odd.unionByName(secret, allowMissingColumns=True).withColumns({c: F.lit(7).cast("long") for c in extra})
    rows = rows.limit(0) if empty else rows
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.cut(stage(spark, now, str(tmp_path)), "odd-stage")
        seen.append((now, after))
        now = after
    (a, b), (_, c), (_, d), (_, e), (_, f) = seen
    assert all(x.schema.names == a.columns for x in (b, c, d, e))
    assert f.count() == e.count() == corpus_pipeline.run(spark, str(tmp_path)).count()
    if empty:
        assert not any(x.count() for x in (b, c, d, e, f))
        return
    listed = lambda x: sorted(((r["doc_id"], r["text"]) for r in x.collect()), key=repr)
    assert listed(b) == listed(a)  # none is toxic
    gone = {r["doc_id"] for r in near_duplicates(b).where("not kept").collect()}
    assert gone == {2, 8, 10} and listed(c) == [r for r in listed(b) if r[0] not in gone]
    assert listed(d) == sorted(((i, None if t is None else mask(t, find_in(t))) for i, t in listed(c)), key=repr)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) and r["a.b"] == 7 for r in d.collect())
    times = {r: listed(e).count(r) // listed(d).count(r) for r in set(listed(d))}
    assert all(times[i, t] == 0 for i, t in times if not (t or "").split()) and max(times.values()) <= 2
    assert {r["doc_id"] for r in f.collect()} == {r["doc_id"] for r in e.collect()} and f.where("not parity").count() == 0
