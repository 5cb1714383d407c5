"""The pipeline: each stage's decisions, seen from outside."""

import corpus_pipeline
import numpy as np
from plaintide.llm import decontaminate, language, lines, simhash
from plaintide.llm.common import table
from plaintide.session import settle
from pyspark.sql import functions as F
from test_lines_mixing import brute_lines
from test_simhash import similar

SF = "/root/testdata/sf0.001"


def test_stages_one_after_the_other(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(settle(stage(spark, frames[-1], SF)))
    assert [f.columns for f in frames[1:5]] == [columns] * 4
    before, spoken, lined, single, clean, mixed = [f.collect() for f in frames]

    model = language.learn(docs)
    assert {r.doc_id for r in spoken} == {r.doc_id for r in before if not model.predict(r.text)[2]}

    expected = {d: kept for d, _, _, kept in brute_lines([(r.doc_id, r.text) for r in spoken])}
    assert {r.doc_id: r.text for r in lined} == expected
    assert all(r.n_chars == len(r.text) for r in lined)

    # Copies by the texts as they were first, then what is left by the texts as they are.
    apart = set(similar({r.doc_id: r.text for r in spoken}).values())
    assert {r.doc_id for r in single} == set(similar({r.doc_id: r.text for r in lined if r.doc_id in apart}).values())

    hit = {r.doc_id for r in decontaminate.contaminated(frames[3], table(spark, SF, "benchmark")).collect()}
    assert hit and {r.doc_id for r in clean} == {r.doc_id for r in single} - hit

    assert {r.doc_id for r in mixed} <= {r.doc_id for r in clean}
    assert max(r.copy for r in mixed) <= 3 and mixed
    assert len({(r.doc_id, r.copy) for r in mixed}) == len(mixed)
    assert simhash.keep_one(frames[3]).count() == len(single)


def test_near_copies_are_dropped_and_clean_pairs_stay(spark):
    """All pairs at 0.8 and more lose one document, whatever lines they share; pairs below it lose none."""
    rng = np.random.default_rng(31)
    rows, near = [], []

    def line():
        return " ".join(f"w{v}" for v in rng.integers(0, 90_000, 14))

    for k in range(60):
        own = [line() for _ in range(12)]
        rows.append((len(rows), "\n".join(own)))
        copy = list(own)
        share = k % 3  # one line in other words: about 0.85; a third of them: about 0.5; none: equal
        for at in range(share if share < 2 else 4):
            copy[3 * at] = line()
        rows.append((len(rows), "\n".join(copy)))
        near.append(share < 2)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    cut = lines.dedup_lines(docs).select("doc_id", F.col("kept_text").alias("text"))
    kept = {r.doc_id for r in simhash.keep_one(settle(cut), 5, 0.8, docs).collect()}
    assert kept == {2 * k for k in range(60)} | {2 * k + 1 for k in range(60) if not near[k]}
    # A document without an original is judged by its own text.
    assert 500 in {r.doc_id for r in simhash.keep_one(cut.union(spark.createDataFrame([(500, line())], cut.schema)), 5, 0.8, docs).collect()}


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns[-1] == "copy" and rows.count() > 0
