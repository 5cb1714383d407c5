"""The registered queries of the text operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaintide.llm import alignment, decontaminate, fingerprints, language, lines, mixing, pii, sharding, simhash, substrings, urls, vectors, warc
from plaintide.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_neighbours(table(spark, sf_dir, "documents"))


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language.learn(documents)
    rows = language.identified(documents.select("doc_id", "text"), model)
    return rows.select("doc_id", language.held_out().alias("held_out"), "language.*")


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return rows.select("doc_id", "size", "source_size", "target", taken)


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(warc.archive_and_read(table(spark, sf_dir, "pages")))


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] <= len(pii.PATTERNS))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [
        F.size(F.filter(kinds, (lambda n: lambda k: k == n)(n + 1))).cast("bigint").alias(f"n_{kind}")
        for n, kind in enumerate(pii.PATTERNS)
    ]
    listed = [F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans")]
    return rows.select("doc_id", *counts, *listed)


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_key")


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.dedup_substrings(table(spark, sf_dir, "documents"), with_text=False)
    return rows.drop("kept_text")


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(urls.RULES), "host string, path string, verdict string")
    rows = urls.filtered(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return rows.select("page_id", "judged.*")


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = vectors.compressed(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(vectors.digest(books)).alias("codebooks_sha256"))


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"))


@query
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shards(table(spark, sf_dir, "documents"))
    law = [F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")]
    return rows.select("doc_id", "size", "text_crc32", *law)


ORACLES["op3_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE
         ELSE 1.0::DOUBLE END AS weight, source_size * 3.0::DOUBLE AS cap
  FROM per_source
), leveled AS (
  SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER before, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM leveled
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, s.source,
         row_number() OVER (PARTITION BY s.source ORDER BY s.size DESC,
           substr(md5(coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 2), s.doc_id NULLS LAST) AS place,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST(CAST('0x' || substr(md5('mix:' || coalesce(s.source, chr(0))), 1, 8) AS UBIGINT) AS DOUBLE)
           / 4294967296.0::DOUBLE AS shift
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST((floor(place * rate + shift) - floor((place - 1) * rate + shift)) * size AS BIGINT) AS taken
FROM placed"""

_LINES = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lined AS (
  SELECT doc_id, parts, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM split
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lined
), firsts AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT k.doc_id, k.pos, k.line, f.first IS NOT NULL AND f.first < k.doc_id AS gone
  FROM keyed k LEFT JOIN firsts f USING (key)
)"""
ORACLES["op8_line_dedup"] = _LINES + """
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""

ORACLES["op9_url_filter"] = r"""
WITH cut AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), judged AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM cut
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged"""

ORACLES["op4_warc"] = """
WITH paid AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), kept AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS keeper
  FROM paid
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM kept"""

ORACLES["op7_substring_dedup"] = r"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS parts FROM documents
), words AS (
  SELECT doc_id, rid, unnest(parts) AS word, unnest(range(len(parts))) AS pos, len(parts) AS n FROM split
), windows AS (
  SELECT *, CASE WHEN pos + 35 <= n THEN md5(string_agg(word, ' ') OVER (
           PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) END AS key
  FROM words
), marked AS (
  SELECT *, key IS NOT NULL AND count(*) OVER (PARTITION BY key) > 1 AS repeated FROM windows
), judged AS (
  SELECT *, bool_or(repeated) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM marked
), summed AS (
  SELECT rid, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM judged GROUP BY rid
)
SELECT doc_id, CAST(len(parts) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN summed USING (rid)"""


def _vector_codes() -> str:
    """The rounds written out: every part is compared with every entry of its codebook."""
    steps = []
    for k in range(vectors.ROUNDS + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
  SELECT rid, p, CAST(min(key) AS BIGINT) % 256 AS e, CAST(min(key) AS BIGINT) // 256 AS d FROM (
    SELECT rid, a.p, (list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)) * 256 + e AS key
    FROM cut a JOIN book{k} b USING (p)) GROUP BY rid, p)""")
        if k < vectors.ROUNDS:
            steps.append(f"""book{k + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(moved, c) AS c FROM book{k} LEFT JOIN (
    SELECT p, e, list(floor(total / n) ORDER BY pos) AS moved FROM (
      SELECT p, e, pos, sum(v) AS total, count(*) AS n FROM (
        SELECT p, e, unnest(x) AS v, unnest(range(len(x))) AS pos FROM cut JOIN near{k} USING (rid, p)) GROUP BY p, e, pos)
    GROUP BY p, e) USING (p, e))""")
    last = vectors.ROUNDS
    return f"""
WITH whole AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label,
         list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS MATERIALIZED (
  SELECT rid, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x FROM whole, range(4) t(p)
), book0 AS MATERIALIZED (
  SELECT p, rid - 1 AS e, x AS c FROM cut WHERE rid <= 256
), {", ".join(steps)}, coded AS (
  SELECT rid, string_agg(lower(lpad(hex(e), 2, '0')), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near{last} GROUP BY rid
), digested AS (
  SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, pos)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(c) AS v, unnest(range(len(c))) AS pos FROM book{last})
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM whole JOIN coded USING (rid), digested"""


ORACLES["op11_vector_codes"] = _vector_codes()
