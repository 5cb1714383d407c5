"""Extra columns of any name go through operators and stages unharmed."""

import corpus_pipeline
from plaintide.llm import decontaminate, language, lines, mixing, simhash, urls
from plaintide.llm.common import table

SF = "/root/testdata/sf0.001"
#: Names that operators use inside, now or once.
NAMES = (
    "_id _hash _dropped _n _text _key _text_key _copies _language _a _l row text_hash dropped hash n d b k t copies answer word words "
    "bits h g salt fp id mask bucket least fresh shape root component_id hits seg spans entity stays language"
).split()


def test_stages_keep_extra_columns(spark):
    docs = table(spark, SF, "documents")
    for k, name in enumerate(NAMES):
        docs = docs.withColumn(name, docs.doc_id * 100 + k)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.columns == (columns if name != "mix" else [*columns, "copy"]), name
        rows = docs.collect()
        assert rows and all(r[c] == r.doc_id * 100 + k for r in rows for k, c in enumerate(NAMES)), name
        docs = spark.createDataFrame(rows, docs.schema)


def test_operators_keep_extra_columns(spark):
    pages = table(spark, SF, "pages").select("page_id", "url")
    pages = pages.select("*", *[pages.page_id.alias(n) for n in NAMES])
    rules = spark.createDataFrame(list(urls.RULES), "host string, path string, verdict string")
    rows = urls.filtered(pages, rules)
    assert rows.columns == [*pages.columns, "judged"]
    assert all(r[n] == r.page_id for r in rows.collect() for n in NAMES)


def test_stages_take_damaged_and_empty_tables(spark):
    schema = table(spark, SF, "documents").schema
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a text of a few plain words here", "xx", None, None)]
    rows += [(None, "a text of a few plain words here", None, "s", 3), (3, "long words of a text " * 20_000, "en", "s", 4), (3, "other words\nand lines", None, None, 4)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            kept = out.collect()
            assert len(kept) <= 3 * len(rows), name
        assert simhash.keep_one(docs).columns == docs.columns
        assert lines.dedup_lines(docs).columns[:5] == docs.columns
        assert mixing.mixed(docs).columns == [*docs.columns, "copy"]
        assert decontaminate.decontaminate(docs, table(spark, SF, "benchmark")).columns == docs.columns
        assert language.identified(docs, language.learn(docs)).columns == [*docs.columns, "language"]
