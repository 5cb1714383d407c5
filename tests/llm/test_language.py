"""Language identification: held-out accuracy, calibration and edge cases."""

import tracemalloc

import numpy as np
from plaintide.llm import language
from plaintide.llm.common import table
from plaintide.llm.queries import QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = table(spark, SF, "documents").select("doc_id", "lang", "text")
    rows = QUERIES["op2_language"](spark, SF).join(truth, "doc_id").toPandas()
    assert len(rows) == truth.count()
    held = rows[rows.held_out & rows.lang.notna()]
    assert len(held) > 100 and (held.lang_pred == held.lang).mean() > 0.98
    assert rows.score.between(0, 1).all()
    assert rows.rejected.mean() < 0.01
    assert rows.groupby("text").lang_pred.nunique().max() == 1


def test_edge_cases(spark):
    base = table(spark, SF, "documents").where("lang IN ('de', 'en')").select("doc_id", "text", "lang")
    extra = spark.createDataFrame(
        [(-1, None, "en"), (-2, "", "en"), (-3, "12 !! ...", "xx"), (None, "the other", "zz"), (-4, "was", None), (-5, "die und " * 200_000, None), (-5, "die und " * 200_000, None)],
        "doc_id bigint, text string, lang string",
    )
    docs = base.unionByName(extra).withColumn("language", F.lit(1)).withColumn("score", F.lit("x"))
    model = language.learn(docs)
    assert set(model.languages) == {"de", "en"}
    got = language.identified(docs, model, "_l").where("doc_id < 0 OR doc_id IS NULL").select("doc_id", "_l.*").collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == 7
    for key in (-1, -2, -3):
        assert (by_id[key].lang_pred, by_id[key].score, by_id[key].rejected) == ("und", 0.0, True)
    assert by_id[-5].lang_pred == "de" and by_id[None].lang_pred == "en"
    nothing = language.learn(docs.withColumn("lang", F.lit(None).cast("string")))
    assert nothing.predict("any text") == ("und", 0.0, True)
    assert language.learn(docs.limit(0)).languages == ()
    one = language.learn(docs.where("lang = 'de'"))
    assert one.predict("die")[:2] == ("de", 1.0)


def test_calibration_rejects_no_more_than_its_share():
    """Noisy two-class counts: scores match frequencies, the threshold keeps nearly all."""
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 2, 1500)
    counts = np.zeros((1500, language.BUCKETS), np.float32)
    counts[np.arange(1500), np.where(rng.random(1500) < 0.8, labels, 1 - labels)] = 10
    counts[:, 7] = 5
    calibrate = np.arange(1500) % 5 == 0
    model = language.train(counts.copy(), labels, ("a", "b"), calibrate)
    shares = counts / counts.sum(axis=1, keepdims=True)
    p = language._softmax((shares @ model.scores + model.bias) / model.temperature)
    assert abs(p.max(axis=1).mean() - (p.argmax(axis=1) == labels).mean()) < 0.06
    assert (p.max(axis=1) < model.threshold).mean() <= 0.02


def test_junk_and_an_unlearnt_language_are_rejected(spark):
    """Letters of no language and languages that nothing is learnt of, while the stated share of clean texts goes."""
    rng = np.random.default_rng(4)
    junk = ["".join(rng.choice(list("bcdfghjklmnpqrstvwxz0123456789 "), 300)) for _ in range(100)]
    foreign = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    ]
    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text", "lang")
    model = language.learn(docs)
    assert all(model.predict(t)[2] for t in junk + foreign)
    clean = language.identified(docs.where("lang IS NOT NULL AND length(text) > 0"), model, "_l")
    assert clean.agg(F.avg(F.col("_l.rejected").cast("double"))).first()[0] <= 1.5 * language.REJECTED_SHARE
    two = language.learn(docs.where("lang IN ('de', 'en')"))
    assert np.mean([two.predict(t)[2] for t in junk]) > 0.9


def test_threshold_keeps_to_the_share():
    scores = np.sort(np.random.default_rng(6).random(5000))
    steps, n = np.unique(np.floor(scores * language.STEPS), return_counts=True)
    at = language.threshold_of(steps, n, 4)
    assert 4 <= (scores < at).sum() <= 5
    few = np.array([70_000.0, 90_000.0]), np.array([1, 9])
    assert language.threshold_of(*few, 4) == 0.625 and language.threshold_of(*few, 2) == 0.7
    assert language.threshold_of(few[0][:0], few[1][:0], 4) == 0.0


def brute_predict(model, text):
    """Subwords one by one in Python's integers."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    data, m = text.lower().encode(), (1 << 32) - 1
    x = [0] + [c if c >= 128 or chr(c).isalpha() else 0 for c in data] + [0]
    x = [c for k, c in enumerate(x) if k == 0 or c or x[k - 1]]
    total, count = np.zeros(len(model.languages)), 0
    for at in range(len(x)):
        h = x[at] * 2654435761 & m
        for n in range(1, 4):
            if at + n >= len(x):
                break
            h = ((h ^ h >> 15) * 2246822519 + x[at + n] * 2654435761) & m
            total += model.scores[((h ^ h >> 13) * 3266489917 & m) >> 19]
            count += 1
    logits = (total / max(1, count) + model.bias) / model.temperature
    p = np.exp(logits - logits.max())
    p /= p.sum()
    return model.languages[int(p.argmax())], float(p.max())


def test_query_equals_brute_force(spark):
    small = "/root/testdata/sf0.001"
    docs = table(spark, small, "documents")
    model = language.learn(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in QUERIES["op2_language"](spark, small).collect():
        lang, score = brute_predict(model, texts[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - score) < 1e-9


def test_every_language_is_learnt(spark):
    """Far more languages than a fixed list would hold, the rarest of a few documents."""
    rng = np.random.default_rng(1)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    rows = []
    for k in range(300):
        words = ["".join(rng.choice(letters, 5)) for _ in range(8)]
        rows += [(len(rows) + i, " ".join(rng.choice(words, 60)), f"l{k:03d}") for i in range(6 if k % 2 else 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.learn(docs)
    learnt = {r.lang for r in docs.where(~language.held_out()).select("lang").distinct().collect()}
    assert len(model.languages) >= 0.97 * len(learnt) > 280


def test_training_never_writes_the_whole_sample_out():
    """The driver holds the counts that are not zero, and the rows of one batch."""
    rng = np.random.default_rng(2)
    rows = 4000
    used = [np.sort(rng.choice(language.BUCKETS, 40, replace=False)).astype(np.uint16) for _ in range(rows)]
    counts = language.Counts(used, [np.ones(40, np.float32) for _ in range(rows)])
    labels = rng.integers(0, 4, rows)
    tracemalloc.start()
    language.train(counts, labels, ("a", "b", "c", "d"), np.arange(rows) % 5 == 0, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < rows * language.BUCKETS * 4 / 8
    dense = np.zeros((50, language.BUCKETS), np.float32)
    dense[np.arange(50), rng.integers(0, language.BUCKETS, 50)] = 3
    shares = language.Counts.of(dense).shares(np.arange(50))
    assert np.array_equal(shares, dense / dense.sum(axis=1, keepdims=True))
