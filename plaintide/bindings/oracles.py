"""SQL counterparts of the named queries, written against the base tables."""

from __future__ import annotations

from plaintide.bindings.tables import COMPANY_VARIANTS, RESOLVED_FLOOR, TREND_END, VOLUME_FLOOR
from plaintide.functions.names import (
    ABBREVIATIONS,
    DROPPED_TOKENS,
    GENERIC_TOKENS,
    LEGAL_FORMS,
)
from plaintide.functions.outcomes import DISPUTED
from plaintide.functions.taxonomy import LEGACY_CARD_SPLIT, RENAMED_LABELS, SHORT_LABELS
from plaintide.plans.entities import INACTIVE_CHARTERS, NON_BANKS


def rnd(value: str, places: int) -> str:
    """Decimal rounding, ties away from zero."""
    return f"round(({value})::DOUBLE::DECIMAL(38, 12), {places})::DOUBLE"


def pct(top: str, bottom: str, places: int = 2) -> str:
    return rnd(f"100.0::DOUBLE * ({top}) / nullif({bottom}, 0)::DOUBLE", places)


def div(top: str, bottom: str, places: int) -> str:
    return rnd(f"({top})::DOUBLE / nullif({bottom}, 0)::DOUBLE", places)


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def as_map(table: dict[str, str]) -> str:
    return f"map([{quoted(table)}], [{quoted(table.values())}])"


# Suppliers with the parts of their names. The trade words and numbers hold no blanks.
_NAMES = """(SELECT s_suppkey, p_name, n_name, s_acctbal, 'K' || lpad(s_suppkey::VARCHAR, 6, '0') AS k,
  split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2
FROM supplier JOIN part ON p_partkey = s_suppkey JOIN nation ON n_nationkey = s_nationkey)"""

CASES = f"""cases AS (
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS complaint_id,
  o_orderdate::DATE AS date_received, l_shipdate::DATE AS date_sent,
  year(o_orderdate)::INTEGER AS "year", month(o_orderdate)::INTEGER AS "month",
  strftime(o_orderdate, '%Y-%m') AS year_month,
  round((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0::DOUBLE, 3) AS days,
  p_type AS product, p_type AS product_short, p_brand AS issue, company_name AS company,
  c_mktsegment AS sub_product, l_linestatus AS sub_issue, n_name AS state,
  CASE n_regionkey WHEN 3 THEN 'territory' WHEN 4 THEN 'military' ELSE 'state' END AS state_type,
  CASE WHEN c_custkey % 5 = 0 THEN lpad(((c_custkey % 100000) // 100)::VARCHAR, 3, '0') || 'XX'
    ELSE lpad((c_custkey % 100000)::VARCHAR, 5, '0') END AS zip_code,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'Servicemember' WHEN 'HOUSEHOLD' THEN 'Older American'
    ELSE 'No tag' END AS tags,
  c_mktsegment = 'MACHINERY' AS servicemember, c_mktsegment = 'HOUSEHOLD' AS older,
  o_orderpriority AS submitted_via, l_quantity >= 25 AS narrative,
  o_orderstatus <> 'P' AS resolved,
  o_orderstatus <> 'P' AND l_returnflag = 'R' AS monetary,
  o_orderstatus <> 'P' AND l_returnflag IN ('R', 'A') AS any_relief,
  o_orderstatus <> 'P' AND l_returnflag = 'N' AS explained,
  l_discount >= 0.09 AS untimely, l_tax >= 0.07 AS disputes,
  CASE WHEN o_orderstatus = 'P' THEN 'In progress' WHEN l_returnflag = 'R' THEN 'Closed with monetary relief'
    WHEN l_returnflag = 'A' THEN 'Closed with non-monetary relief' ELSE 'Closed with explanation' END AS response,
  o_orderdate::DATE <= DATE '{TREND_END}' AS in_window
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
JOIN (SELECT s_suppkey, {COMPANY_VARIANTS} AS company_name FROM {_NAMES}) ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey)"""

RAW = f"""raw AS (
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS complaint_id,
  CASE WHEN o_orderkey % 500 <> 1 THEN o_orderdate + CASE o_orderkey % 3
    WHEN 0 THEN INTERVAL 12 HOUR WHEN 1 THEN INTERVAL 17 HOUR ELSE INTERVAL 750 MINUTE END END AS received,
  l_shipdate + INTERVAL 17 HOUR AS sent,
  CASE p_type WHEN 'ECONOMY' THEN 'Credit card or prepaid card'
    WHEN 'LARGE' THEN 'Payday loan, title loan, or personal loan' WHEN 'MEDIUM' THEN 'Mortgage'
    WHEN 'PROMO' THEN 'Student loan' WHEN 'SMALL' THEN 'Checking or savings account'
    ELSE 'Vehicle loan or lease' END AS product,
  [{quoted(LEGACY_CARD_SPLIT)}, 'Other card', NULL][p_size % 9 + 1] AS sub_product,
  CASE WHEN p_brand <> 'Brand#25' THEN '  ' || p_brand || ' ' END AS issue,
  CASE WHEN l_linenumber <> 7 THEN l_linestatus END AS sub_issue,
  CASE l_linenumber % 4 WHEN 0 THEN s_name WHEN 1 THEN upper(s_name) || ', Inc.'
    WHEN 2 THEN '  The ' || s_name || '  LLC' ELSE replace(s_name, '#', '  ') || ' Corp., Inc.' END AS company,
  'SUPPLIER ' || right(s_name, 9) AS company_key,
  ['CA', 'tx ', 'NY', 'FL', 'il', ' PA', 'OH', 'GA', 'NC', 'MI', 'NJ', 'VA', 'WA', 'AZ', 'MA', 'TN', 'IN',
   'MO', 'DC', 'PR', 'GU', 'AE', 'ZZ', 'United States Minor Outlying Islands', NULL][n_nationkey + 1] AS state,
  CASE WHEN c_custkey % 50 = 3 THEN NULL WHEN c_custkey % 50 = 7 THEN 'xxxxx'
    WHEN c_custkey % 5 = 0 THEN lpad(((c_custkey % 100000) // 100)::VARCHAR, 3, '0') || 'xx'
    ELSE lpad((c_custkey % 100000)::VARCHAR, 5, '0') END AS zip_code,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'Servicemember' WHEN 'HOUSEHOLD' THEN 'Older American, Servicemember'
    WHEN 'FURNITURE' THEN ' Older American ' END AS tags,
  o_orderpriority AS submitted_via,
  CASE WHEN l_tax >= 0.07 THEN '{DISPUTED}' END AS public_response,
  CASE WHEN l_quantity = 1 THEN NULL WHEN o_orderstatus = 'P' THEN 'In progress'
    WHEN l_returnflag = 'R' THEN 'Closed with monetary relief'
    WHEN l_returnflag = 'A' THEN 'Closed with non-monetary relief' ELSE 'Closed with explanation' END AS response,
  CASE WHEN l_discount >= 0.09 THEN 'No' WHEN l_discount > 0 THEN 'Yes' END AS timely,
  l_quantity >= 25 AS narrative
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey)"""

# The cleaning stage up to the dedupe.
PREPARED = f"""{RAW}, typed AS (
SELECT *, product AS product_raw,
  CASE WHEN product = 'Credit card or prepaid card'
    THEN coalesce({as_map(LEGACY_CARD_SPLIT)}[sub_product], 'Credit card')
    ELSE coalesce({as_map(RENAMED_LABELS)}[product], product) END AS product_now,
  product IN ('Credit card or prepaid card', {quoted(RENAMED_LABELS)}) AS legacy,
  CASE WHEN upper(trim(state)) = 'UNITED STATES MINOR OUTLYING ISLANDS' THEN 'UM' ELSE upper(trim(state)) END AS code,
  upper(trim(coalesce(zip_code, ''))) AS zip,
  round((epoch_us(sent) - epoch_us(received)) / 86400000000.0::DOUBLE, 3) AS days,
  trim(regexp_replace(company, '\\s+', ' ', 'g')) AS company_raw
FROM raw), spelled AS (
SELECT company_key, company_raw, count(*) AS n FROM typed GROUP BY ALL), canon AS (
SELECT company_key, arg_min(company_raw, (-n, company_raw)) AS company_clean, count(*) AS spellings,
  sum(n)::BIGINT AS n_complaints FROM spelled GROUP BY company_key), prepared AS (
SELECT complaint_id, received::DATE AS date_received, received AS date_received_ts,
  sent::DATE AS date_sent_to_company, year(received)::INTEGER AS "year", month(received)::INTEGER AS "month",
  strftime(received, '%Y-%m') AS year_month, days AS days_to_company, product_now AS product,
  coalesce({as_map(SHORT_LABELS)}[product_now], product_now) AS product_short, product_raw,
  coalesce(trim(sub_product), 'Not specified') AS sub_product, coalesce(trim(issue), 'Not specified') AS issue,
  coalesce(trim(sub_issue), 'Not specified') AS sub_issue, company_clean AS company, company_raw, company_key,
  coalesce(code, 'Unknown') AS state,
  CASE WHEN code IN ('PR', 'GU', 'UM') THEN 'territory' WHEN code = 'AE' THEN 'military'
    WHEN code IS NULL OR code = 'ZZ' THEN 'unknown' ELSE 'state' END AS state_type,
  zip AS zip_code, CASE WHEN regexp_matches(left(zip, 3), '^[0-9]{{3}}$') THEN left(zip, 3) END AS zip3,
  coalesce(trim(tags), 'No tag') AS tags, coalesce(tags LIKE '%Servicemember%', false) AS is_servicemember,
  coalesce(tags LIKE '%Older American%', false) AS is_older_american, submitted_via,
  coalesce(response, 'Unknown') AS company_response,
  coalesce(public_response, 'No public response provided') AS company_public_response,
  coalesce(timely, 'Unknown') AS timely, narrative AS has_narrative,
  coalesce(response <> 'In progress', false) AS is_resolved,
  coalesce(response = 'Closed with monetary relief', false) AS got_monetary_relief,
  coalesce(response IN ('Closed with monetary relief', 'Closed with non-monetary relief'), false) AS got_any_relief,
  coalesce(response = 'Closed with explanation', false) AS closed_explanation_only,
  coalesce(timely = 'No', false) AS is_untimely, public_response IS NOT NULL AS company_disputes_facts,
  code IS NULL AS dq_state_missing, zip LIKE '%X%' AS dq_zip_masked, sub_issue IS NULL AS dq_sub_issue_missing,
  coalesce(response = 'In progress', false) AS dq_response_in_progress,
  coalesce(days > 365, false) AS dq_long_routing_lag,
  coalesce(received::DATE > DATE '{TREND_END}', false) AS dq_partial_period, legacy AS dq_legacy_product_label,
  NOT coalesce(received::DATE > DATE '{TREND_END}', false) AS in_trend_window
FROM typed JOIN canon USING (company_key))"""

CLEAN = f"""{PREPARED}, clean AS (
SELECT * FROM prepared QUALIFY row_number() OVER (PARTITION BY date_received_ts, company_key, product, sub_product,
  issue, sub_issue, state, zip_code, submitted_via
  ORDER BY (date_received IS NOT NULL)::INT + (date_sent_to_company IS NOT NULL)::INT + (zip3 IS NOT NULL)::INT
    + (days_to_company IS NOT NULL)::INT DESC, complaint_id) = 1)"""

INSTITUTIONS = """inst AS (
SELECT s_name AS name, s_suppkey AS cert, 'S' || s_nationkey AS stalp,
  CASE WHEN s_suppkey % 50 = 49 THEN 0 ELSE (s_acctbal * 1000)::DECIMAL(20,2) END AS asset,
  CASE WHEN s_suppkey % 7 = 0 THEN 'CERT:' || s_suppkey ELSE n_name END AS group_key,
  CASE WHEN s_suppkey % 7 = 0 THEN s_name ELSE n_name END AS group_name, s_suppkey % 7 <> 0 AS has_parent
FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0), grp AS (
SELECT group_key, any_value(group_name) AS group_name, sum(asset)::DECIMAL(20,2) AS total_assets_k,
  count(*) AS n_charters, any_value(has_parent) AS has_holding_company,
  round((sum(asset)::DOUBLE / 1e6)::DOUBLE::DECIMAL(38, 12), 3)::DOUBLE AS total_assets_b FROM inst GROUP BY group_key)"""

# Names on both sides of the match.
NAMED = f"""named AS (SELECT * FROM {_NAMES}), companies AS (
SELECT {COMPANY_VARIANTS} AS company, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS n_complaints
FROM named WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)), charters AS (
SELECT CASE WHEN s_suppkey = 8 THEN 'Citibank, National Association'
  ELSE p_name || ' ' || n_name || ' ' || k || ' Bank, National Association' END AS name, s_suppkey AS cert,
  (s_acctbal * 1000)::DECIMAL(20,2) AS asset,
  CASE WHEN s_suppkey % 7 = 0 THEN 'CERT:' || s_suppkey ELSE n_name END AS group_key, s_suppkey % 7 <> 0 AS has_parent
FROM named WHERE s_acctbal > 0), groups AS (
SELECT group_key, CASE WHEN any_value(has_parent) THEN group_key ELSE any_value(name) END AS group_name,
  sum(asset)::DECIMAL(20,2) AS total_k, count(*) AS n_charters FROM charters GROUP BY group_key)"""


def _norm(name: str) -> str:
    text = f"replace(upper({name}), '&', ' AND ')"
    text = f"regexp_replace({text}, '\\bN\\.\\s*A\\.', ' NATIONAL ASSOCIATION ', 'g')"
    text = f"trim(regexp_replace({text}, '[^A-Z0-9]+', ' ', 'g'))"
    text = f"regexp_replace({text}, '\\bN A\\b', ' NATIONAL ASSOCIATION ', 'g')"
    text = f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"
    text = f"regexp_replace(regexp_replace({text}, '^THE ', ''), ' THE$', '')"
    words = f"list_transform(string_split({text}, ' '), lambda w: coalesce({as_map(ABBREVIATIONS)}[w], w))"
    return f"array_to_string(list_filter({words}, lambda w: w NOT IN ({quoted(DROPPED_TOKENS)})), ' ')"


def _sig(norm: str) -> str:
    kept = f"list_filter(string_split({norm}, ' '), lambda w: length(w) >= 3 AND w NOT IN ({quoted(GENERIC_TOKENS)}))"
    return f"list_sort(list_distinct({kept}))"


CANDIDATES = f"""{NAMED}, candidates AS (
SELECT norm, arg_min(group_key, place) AS group_key, arg_min(source, place) AS source FROM (
  SELECT {_norm('group_name')} AS norm, group_key, 'holding_company' AS source,
    (0, -total_k::DOUBLE, 0, group_key) AS place FROM groups UNION ALL
  SELECT {_norm('name')}, group_key, 'charter', (1, 0.0::DOUBLE, cert, group_key) FROM charters)
WHERE length(norm) > 2 GROUP BY norm)"""

_DECLARED = (
    "CASE "
    + " ".join(f"WHEN regexp_matches(norm, '^{key}( |$)') THEN 'known_non_bank'" for key in NON_BANKS)
    + f" WHEN upper(company) IN ({quoted(INACTIVE_CHARTERS)}) THEN 'inactive_charter'"
    " WHEN upper(company) LIKE '%CREDIT UNION%' OR upper(company) LIKE '% FCU%' THEN 'ncua_credit_union' END"
)

# Longest common subsequence: the letters of the right text sweep a number that has one bit for each place of the left one.
_LCS = """la - bit_count(list_reduce(
  list_prepend((1::HUGEINT << la) - 1, list_transform(string_split(rb, ''), lambda c: list_sum(list_transform(
    range(la), lambda i: CASE WHEN ra[(i + 1)::INT] = c THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END))::HUGEINT)),
  lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((1::HUGEINT << la) - 1)))"""

MATCHES = f"""{CANDIDATES}, left_side AS (
SELECT company, n_complaints, norm, {_sig('norm')} AS sig, {_DECLARED} AS declared
FROM (SELECT *, {_norm('company')} AS norm FROM companies)), right_side AS (
SELECT norm AS cand, group_key, {_sig('norm')} AS cand_sig FROM candidates), decided AS (
SELECT l.*, CASE WHEN declared IS NOT NULL THEN declared WHEN upper(company) = 'CITIBANK, N.A.' AND o.group_key IS NOT NULL
    THEN 'manual_override' WHEN r.group_key IS NOT NULL THEN 'exact_normalised' END AS method,
  CASE WHEN declared IS NOT NULL THEN NULL WHEN upper(company) = 'CITIBANK, N.A.' AND o.group_key IS NOT NULL
    THEN o.group_key ELSE r.group_key END AS group_key
FROM left_side l LEFT JOIN right_side r ON r.cand = l.norm
LEFT JOIN (SELECT group_key FROM charters WHERE name = 'Citibank, National Association') o ON true), pairs AS (
SELECT d.company, d.norm, d.sig, r.cand, r.cand_sig, r.group_key, len(list_intersect(d.sig, r.cand_sig)) AS shared,
  len(list_distinct(list_concat(d.sig, r.cand_sig))) AS either
FROM decided d, right_side r WHERE d.method IS NULL AND d.norm <> ''), name_parts AS (
SELECT *, coalesce(shared::DOUBLE / nullif(either, 0), 0) AS jaccard,
  array_to_string(list_sort(list_distinct(list_intersect(a, b))), ' ') AS common,
  array_to_string(list_sort(list_distinct(list_filter(a, lambda w: NOT list_contains(b, w)))), ' ') AS ra,
  array_to_string(list_sort(list_distinct(list_filter(b, lambda w: NOT list_contains(a, w)))), ' ') AS rb
FROM (SELECT *, string_split(norm, ' ') AS a, string_split(cand, ' ') AS b FROM pairs)), name_lengths AS (
SELECT *, length(common) AS lc, CASE WHEN common = '' THEN 0 ELSE 1 END AS gap, length(ra) AS la, length(rb) AS lb,
  CASE WHEN ra <> '' AND rb <> '' THEN {_LCS} ELSE 0 END AS lcs FROM name_parts), name_scores AS (
SELECT *, CASE WHEN lc > 0 AND (la = 0 OR lb = 0) THEN 100.0::DOUBLE ELSE greatest(
  100.0::DOUBLE - 100.0::DOUBLE * (la + lb - 2 * lcs) / (2 * lc + 2 * gap + la + lb),
  CASE WHEN lc > 0 THEN 100.0::DOUBLE - 100.0::DOUBLE * (gap + la) / (2 * lc + gap + la) ELSE 0 END,
  CASE WHEN lc > 0 THEN 100.0::DOUBLE - 100.0::DOUBLE * (gap + lb) / (2 * lc + gap + lb) ELSE 0 END) END AS score
FROM name_lengths), best_pairs AS (
SELECT * FROM name_scores WHERE score >= 75 OR (len(sig) >= 2 AND sig = cand_sig)
QUALIFY row_number() OVER (PARTITION BY company ORDER BY jaccard DESC, score DESC, cand) = 1), verdicts AS (
SELECT d.company, d.n_complaints, CASE WHEN d.method IS NOT NULL THEN d.method WHEN d.norm = '' THEN 'no_candidate'
    WHEN b.company IS NULL THEN 'no_match'
    WHEN len(d.sig) >= 2 AND b.sig = b.cand_sig THEN 'token_set_identical'
    WHEN score >= 92 AND shared >= 2 AND jaccard >= 0.6 THEN 'fuzzy_auto'
    WHEN score >= 92 AND shared > 0 THEN 'rejected_weak_token_overlap' WHEN score >= 92 THEN 'rejected_no_shared_token'
    ELSE 'below_threshold' END AS method, d.group_key AS known, b.group_key AS found, b.score, d.method AS early
FROM decided d LEFT JOIN best_pairs b ON b.company = d.company), matches AS (
SELECT company, n_complaints, method IN ('manual_override', 'exact_normalised', 'token_set_identical', 'fuzzy_auto') AS matched,
  v.group_key, group_name AS fdic_name, round((total_k::DOUBLE / 1e6)::DOUBLE::DECIMAL(38, 12), 3)::DOUBLE AS total_assets_b, n_charters,
  CASE WHEN early IN ('manual_override', 'exact_normalised') THEN 100.0::DOUBLE ELSE round((score)::DOUBLE::DECIMAL(38, 12), 1)::DOUBLE END AS match_score,
  method AS match_method
FROM (SELECT *, CASE WHEN early IS NOT NULL THEN known WHEN method IN ('token_set_identical', 'fuzzy_auto') THEN found END
  AS group_key FROM verdicts) v LEFT JOIN groups USING (group_key))"""

ENRICHED = f"""{CASES}, {MATCHES}, enriched AS (
SELECT company, total_complaints, complaints_in_trend_window, avg_days_to_company,
  nullif(r, 0) AS resolved_complaints, CASE WHEN r > 0 THEN m END AS monetary_relief_n,
  CASE WHEN r > 0 THEN u END AS untimely_n, {pct('m', 'r', 3)} AS monetary_relief_rate,
  {pct('u', 'r', 3)} AS untimely_rate, coalesce(matched, false) AS matched, fdic_name, group_key,
  total_assets_b, n_charters, match_score, match_method,
  CASE WHEN matched THEN {div('total_complaints', 'total_assets_b', 3)} END AS complaints_per_1b_assets
FROM (SELECT company, count(*) AS total_complaints, count(*) FILTER (in_window) AS complaints_in_trend_window,
  {rnd('avg(days)', 3)} AS avg_days_to_company, count(*) FILTER (resolved) AS r,
  count(*) FILTER (resolved AND monetary) AS m, count(*) FILTER (resolved AND untimely) AS u
  FROM cases GROUP BY company) LEFT JOIN matches USING (company))"""

RATES = f"""{ENRICHED}, base AS (
SELECT company, count(*) AS total_complaints, count(DISTINCT product) AS products_touched,
  count(DISTINCT state) FILTER (state_type = 'state') AS states_touched, min(date_received) AS first_complaint,
  max(date_received) AS last_complaint, count(*) FILTER (servicemember) AS servicemember_complaints,
  count(*) FILTER (older) AS older_american_complaints, count(*) FILTER (narrative) AS with_narrative,
  {rnd('avg(days) FILTER (days <= 365)', 3)} AS avg_days_to_company,
  {rnd('quantile_cont(days, 0.5)', 3)} AS median_days_to_company,
  {rnd('quantile_cont(days, 0.9)', 3)} AS p90_days_to_company, count(*) FILTER (resolved) AS resolved_complaints,
  count(*) FILTER (monetary) AS monetary_relief_n, count(*) FILTER (any_relief) AS any_relief_n,
  count(*) FILTER (explained) AS explanation_only_n, count(*) FILTER (resolved AND untimely) AS untimely_n,
  count(*) FILTER (resolved AND disputes) AS disputes_facts_n
FROM cases WHERE in_window GROUP BY company), rates AS (
SELECT b.*, e.matched, e.fdic_name, e.total_assets_b, e.n_charters, e.match_method,
  {pct('b.monetary_relief_n', 'b.resolved_complaints', 3)} AS monetary_relief_rate,
  {pct('any_relief_n', 'b.resolved_complaints', 3)} AS any_relief_rate,
  {rnd('100.0 - ' + pct('any_relief_n', 'b.resolved_complaints', 3), 3)} AS pct_no_relief,
  {pct('explanation_only_n', 'b.resolved_complaints', 3)} AS explanation_only_rate,
  {pct('b.untimely_n', 'b.resolved_complaints', 3)} AS untimely_rate,
  {pct('disputes_facts_n', 'b.resolved_complaints', 3)} AS disputes_facts_rate,
  {pct('servicemember_complaints', 'b.total_complaints', 3)} AS pct_servicemember,
  {pct('older_american_complaints', 'b.total_complaints', 3)} AS pct_older_american,
  {div('b.total_complaints', 'e.total_assets_b', 3)} AS complaints_per_1b_assets
FROM base b JOIN enriched e USING (company))"""


def _percentile(column: str, condition: str) -> str:
    """Average-tie percentile among the rows that meet the condition."""
    group = f"(PARTITION BY ({condition}) AND {column} IS NOT NULL"
    value = (
        f"100.0::DOUBLE * ((rank() OVER {group} ORDER BY {column}) - 1)"
        f" + (count(*) OVER (PARTITION BY ({condition}), {column}) + 1) / 2.0::DOUBLE)"
        f" / count(*) OVER {group})"
    )
    return f"CASE WHEN ({condition}) AND {column} IS NOT NULL THEN {rnd(value, 2)} END"


_SCORED = f"total_complaints >= {VOLUME_FLOOR}"
_COHORT = f"{_SCORED} AND matched AND complaints_per_1b_assets IS NOT NULL"
PROFILE = f"""{RATES}, parts AS (
SELECT *, {_percentile('pct_no_relief', _SCORED)} AS pctile_pct_no_relief,
  {_percentile('untimely_rate', _SCORED)} AS pctile_untimely_rate,
  {_percentile('disputes_facts_rate', _SCORED)} AS pctile_disputes_facts_rate,
  {_percentile('avg_days_to_company', _SCORED)} AS pctile_avg_days_to_company FROM rates), conduct AS (
SELECT *, {rnd('pctile_pct_no_relief * 0.40::DOUBLE + pctile_untimely_rate * 0.35::DOUBLE'
               ' + pctile_disputes_facts_rate * 0.15::DOUBLE + pctile_avg_days_to_company * 0.10::DOUBLE', 2)}
  AS conduct_risk_score FROM parts), exposure AS (
SELECT *, {_percentile('complaints_per_1b_assets', _COHORT)} AS pctile_complaints_per_1b_assets,
  {_percentile('conduct_risk_score', _COHORT)} AS again FROM conduct), profile AS (
SELECT * EXCLUDE (again), {rnd('again * 0.60::DOUBLE + pctile_complaints_per_1b_assets * 0.40::DOUBLE', 2)}
  AS exposure_risk_score,
  CASE WHEN conduct_risk_score <= 25 THEN 'Low' WHEN conduct_risk_score <= 50 THEN 'Moderate'
    WHEN conduct_risk_score <= 75 THEN 'Elevated' WHEN conduct_risk_score <= 90 THEN 'High'
    WHEN conduct_risk_score IS NOT NULL THEN 'Severe' END AS risk_tier FROM exposure)"""

SUMMARY = f"""{PROFILE}, summary AS (
SELECT company, total_complaints, resolved_complaints, products_touched, states_touched, first_complaint,
  last_complaint, monetary_relief_rate, any_relief_rate, pct_no_relief, explanation_only_rate, untimely_rate,
  disputes_facts_rate, avg_days_to_company, median_days_to_company, p90_days_to_company, pct_servicemember,
  pct_older_american, matched AS is_fdic_matched, fdic_name, total_assets_b, n_charters, complaints_per_1b_assets,
  conduct_risk_score, exposure_risk_score, risk_tier,
  CASE WHEN matched THEN 'FDIC-insured depository' ELSE coalesce(map(['known_non_bank', 'ncua_credit_union', 'inactive_charter'],
    ['Non-bank: no FDIC charter', 'Credit union: NCUA-insured, not in FDIC data', 'Charter no longer active (merged/acquired)'])[match_method],
    'No confident FDIC match') END AS fdic_status,
  rank() OVER (ORDER BY total_complaints DESC) AS overall_volume_rank,
  CASE WHEN {_COHORT} THEN rank() OVER (PARTITION BY {_COHORT} ORDER BY total_complaints DESC) END AS volume_rank,
  CASE WHEN {_COHORT} THEN rank() OVER (PARTITION BY {_COHORT} ORDER BY complaints_per_1b_assets DESC) END
    AS size_adjusted_rank
FROM profile WHERE {_SCORED})"""

STATES = f"""{CASES}, scope AS (SELECT * FROM cases WHERE in_window AND state_type = 'state'), totals AS (
SELECT state, count(*) AS complaints, count(*) FILTER (resolved) AS resolved, count(*) FILTER (monetary) AS m,
  count(*) FILTER (untimely) AS u, count(DISTINCT company) AS companies,
  {rnd('avg(days) FILTER (days <= 365)', 2)} AS avg_days_to_company FROM scope GROUP BY state), by_issue AS (
SELECT state, issue, count(*) AS n FROM scope GROUP BY state, issue
  QUALIFY row_number() OVER (PARTITION BY state ORDER BY count(*) DESC, issue) = 1), by_product AS (
SELECT state, product_short, count(*) AS n FROM scope GROUP BY state, product_short
  QUALIFY row_number() OVER (PARTITION BY state ORDER BY count(*) DESC, product_short) = 1)"""

MONTHLY = f"""{CASES}, monthly AS (
SELECT product, product_short, year_month, min(date_received) AS month_start, count(*) AS complaints,
  count(*) FILTER (resolved) AS resolved, count(*) FILTER (monetary) AS monetary_relief,
  count(*) FILTER (untimely) AS untimely FROM cases WHERE in_window GROUP BY ALL)"""

OVERALL = f"""{CASES}, overall AS (
SELECT year_month, count(*) AS complaints, count(*) FILTER (monetary) AS monetary_relief,
  count(*) FILTER (untimely) AS untimely, count(*) FILTER (resolved) AS resolved
FROM cases WHERE in_window GROUP BY year_month)"""

FLOOR = "50"


def _outcome_table(key: str, floor: int = 0) -> str:
    return f"""{CASES}, wide AS (
SELECT {key} AS g, count(*) FILTER (monetary) AS yes, count(*) FILTER (NOT monetary) AS no, count(*) AS r
FROM cases WHERE resolved AND in_window GROUP BY 1 HAVING count(*) >= {floor}), cells AS (
SELECT g, r, outcome, o, sum(o) OVER (PARTITION BY outcome) AS c, sum(o) OVER () AS n FROM (
  SELECT g, r, 'Monetary relief' AS outcome, yes AS o FROM wide UNION ALL
  SELECT g, r, 'No monetary relief', no FROM wide)), scored AS (
SELECT *, r::DOUBLE * c / n AS e FROM cells)"""


def _chi_square(key: str, floor: int = 0) -> str:
    return f"""WITH {_outcome_table(key, floor)}, one AS (
SELECT sum((o - e) ^ 2 / e) AS chi, (count(DISTINCT g) - 1)::BIGINT AS dof, sum(o)::BIGINT AS n FROM scored)
SELECT round((chi)::DOUBLE::DECIMAL(38, 12), 6)::DOUBLE AS statistic, dof, n, round((sqrt(chi / n))::DOUBLE::DECIMAL(38, 12), 6)::DOUBLE AS cramers_v,
  CASE WHEN sqrt(chi / n) < 0.10 THEN 'negligible' WHEN sqrt(chi / n) < 0.20 THEN 'weak'
    WHEN sqrt(chi / n) < 0.30 THEN 'moderate' ELSE 'strong' END AS strength FROM one"""


_PAIR_MEASURES = [
    "total_complaints", "total_assets_b", "complaints_per_1b_assets", "monetary_relief_rate", "untimely_rate",
    "avg_days_to_company",
]


def _spearman(source: str, pairs: list[tuple[str, str]], extra: str = "") -> str:
    def average(column: str) -> str:
        return f"rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0::DOUBLE"

    parts = [
        f"SELECT '{a}' AS measure_a, '{b}' AS measure_b, count(*) AS n, round((corr(x, y))::DOUBLE::DECIMAL(38, 12), 6)::DOUBLE AS rho{extra} FROM ("
        f"SELECT {average(a)} AS x, {average(b)} AS y FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        for a, b in pairs
    ]
    return " UNION ALL ".join(parts)


_UPPER = [(a, b) for i, a in enumerate(_PAIR_MEASURES) for b in _PAIR_MEASURES[i:]]
_SENSITIVE = f"""{ENRICHED}, counts AS (
SELECT company, count(*) AS n_with, count(*) FILTER (year_month <> '1998-04') AS n_without
FROM cases WHERE in_window GROUP BY company HAVING count(*) >= {VOLUME_FLOOR}), shifted AS (
SELECT company, n_with, n_without, total_assets_b, {div('n_with', 'total_assets_b', 2)} AS rate_with,
  {div('n_without', 'total_assets_b', 2)} AS rate_without, {pct('n_with - n_without', 'n_with', 1)} AS pct_from_month
FROM counts JOIN enriched USING (company) WHERE matched), shifts AS (
SELECT *, CASE WHEN rate_with IS NOT NULL THEN rank() OVER (ORDER BY rate_with DESC NULLS LAST) END AS rank_with,
  CASE WHEN rate_without IS NOT NULL THEN rank() OVER (ORDER BY rate_without DESC NULLS LAST) END AS rank_without
FROM shifted)"""


def _column_rows(source: str, columns: list[str], expression: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {expression.format(c=c)} FROM {source}" for c in columns
    )


_RAW_NULLABLE = {
    "complaint_id": "complaint_id", "date_received": "1", "date_sent_to_company": "sent", "product": "product",
    "sub_product": "sub_product", "issue": "issue", "sub_issue": "sub_issue", "company": "company", "state": "state",
    "zip_code": "zip_code", "tags": "tags", "submitted_via": "submitted_via",
    "company_public_response": "public_response", "company_response": "response", "timely": "timely",
    "has_narrative": "narrative",
}

_CLEAN_COLUMNS = """complaint_id date_received date_received_ts date_sent_to_company year month year_month days_to_company
product product_short product_raw sub_product issue sub_issue company company_raw company_key state state_type zip_code
zip3 tags is_servicemember is_older_american submitted_via company_response company_public_response timely has_narrative
is_resolved got_monetary_relief got_any_relief closed_explanation_only is_untimely company_disputes_facts
dq_state_missing dq_zip_masked dq_sub_issue_missing dq_response_in_progress dq_long_routing_lag dq_partial_period
dq_legacy_product_label in_trend_window""".split()

_METRICS = {
    "rows": "count(*)",
    "unparsed_date_received": "count(*) FILTER (date_received IS NULL)",
    "sent_before_received": "count(*) FILTER (days_to_company < 0)",
    "lag_over_365_days": "count(*) FILTER (days_to_company > 365)",
    "median_lag": rnd("quantile_cont(days_to_company, 0.5)", 2),
    "p95_lag": rnd("quantile_cont(days_to_company, 0.95)", 2),
    "legacy_card_rows": "count(*) FILTER (product_raw = 'Credit card or prepaid card')",
    "legacy_card_to_credit": "count(*) FILTER (product_raw = 'Credit card or prepaid card' AND sub_product IN "
    "('General-purpose credit card or charge card', 'Store credit card'))",
    "legacy_card_to_prepaid": "count(*) FILTER (product_raw = 'Credit card or prepaid card' AND sub_product IN "
    "('General-purpose prepaid card', 'Government benefit card', 'Gift card', 'Payroll card', 'Student prepaid card'))",
    "legacy_card_unmapped": "count(*) FILTER (product_raw = 'Credit card or prepaid card' AND sub_product IN "
    "('Other card', 'Not specified'))",
    "renamed_product_rows": "count(*) FILTER (product_raw LIKE 'Payday%')",
    "state_spelled_out": "count(*) FILTER (state = 'UM')",
    "state_missing": "count(*) FILTER (state = 'Unknown')",
    "zip_masked": "count(*) FILTER (zip_code LIKE '%X%')",
    "zip3_recovered": "count(zip3)",
    "no_tag": "count(*) FILTER (tags = 'No tag')",
    "sub_issue_missing": "count(*) FILTER (sub_issue = 'Not specified')",
    "in_progress": "count(*) FILTER (company_response = 'In progress')",
    "resolved": "count(*) FILTER (company_response NOT IN ('In progress', 'Unknown'))",
    "partial_period": "count(*) FILTER (NOT in_trend_window)",
}

_BASELINE = {"relief": "monetary", "any_relief": "any_relief", "untimely": "untimely", "explanation": "explained"}
_BASELINE_COLUMNS = ", ".join(
    f"round((100.0::DOUBLE * {n}_n / resolved)::DOUBLE::DECIMAL(38, 12), 3)::DOUBLE AS {n}_rate, "
    f"round((100.0::DOUBLE * t_{n} / t_resolved)::DOUBLE::DECIMAL(38, 12), 3)::DOUBLE AS national_{n}_rate, "
    f"round(((100.0::DOUBLE * {n}_n / resolved) / (100.0::DOUBLE * t_{n} / t_resolved))::DOUBLE::DECIMAL(38, 12), 3)::DOUBLE AS {n}_x_national"
    for n in _BASELINE
)


def _trend(source: str) -> str:
    def lagged(step: int) -> str:
        return f"lag(complaints, {step}) OVER w"

    return f"""SELECT product, product_short, year_month, month_start, complaints, {lagged(1)} AS prev_month,
  complaints - {lagged(1)} AS mom_change, {pct(f'complaints - {lagged(1)}', lagged(1))} AS mom_pct_change,
  {lagged(12)} AS same_month_last_year, {pct(f'complaints - {lagged(12)}', lagged(12))} AS yoy_pct_change,
  round((avg(complaints) OVER (PARTITION BY product ORDER BY year_month ROWS 2 PRECEDING))::DOUBLE::DECIMAL(38, 12), 1)::DOUBLE AS moving_avg_3m,
  {pct('complaints - first_value(complaints) OVER w', 'first_value(complaints) OVER w')} AS pct_change_since_start,
  monetary_relief, untimely, {pct('untimely', 'complaints')} AS untimely_rate, lead(complaints) OVER w AS next_month
FROM {source} WINDOW w AS (PARTITION BY product ORDER BY year_month)"""


ORACLES: dict[str, str] = {
    "scan_strings": "SELECT doc_id::VARCHAR AS doc_id, lang, source, n_chars::VARCHAR AS n_chars, text FROM documents",
    "bulk_scope_filter": f"""WITH {CASES} SELECT complaint_id, strftime(date_received, '%Y-%m-%d') AS date_received,
  product, issue, sub_issue AS timely, submitted_via, NULL::VARCHAR AS state, p_name AS complaint_what_happened
FROM cases JOIN part ON p_partkey = split_part(complaint_id, '-', 3)::BIGINT
WHERE date_received BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND product IN ('ECONOMY', 'PROMO')""",
    "json_pages": """SELECT event_id::VARCHAR AS complaint_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS date_received,
  event_type AS product, NULL::VARCHAR AS company, props AS complaint_what_happened FROM events""",
    "institution_scan": """SELECT s_name AS name, s_suppkey::VARCHAR AS cert, n_name AS city, 'S' || s_nationkey AS stalp,
  CASE WHEN s_suppkey % 7 = 0 THEN ' ' ELSE n_name END AS namehcr
FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0""",
    "ingest_dedupe": """SELECT l_orderkey AS complaint_id, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
WHERE l_quantity > 1 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) = 1""",
    "ingest_incremental": """SELECT o_orderkey::VARCHAR AS complaint_id, strftime(o_orderdate, '%Y-%m-%d') AS date_received,
  o_orderpriority AS submitted_via FROM orders""",
    "narrative_split": """SELECT doc_id AS complaint_id, md5(t) AS text_md5, length(t) AS chars
FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents) WHERE t <> ''""",
    "limit_extract": """SELECT o_orderkey, o_orderdate::DATE AS o_orderdate, o_orderpriority FROM orders
ORDER BY orders.o_orderdate DESC, o_orderkey LIMIT 500""",
    "column_population": f"WITH {RAW} SELECT column_name, row_count, populated, {pct('populated', 'row_count', 1)} AS pct_populated FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, count({x}) AS populated FROM raw"
        for c, x in _RAW_NULLABLE.items()
    )
    + ")",
    "typed_load": """SELECT o_orderkey AS complaint_id, o_orderdate::DATE AS date_received, nullif(o_orderstatus, 'F') AS status,
  o_totalprice::DECIMAL(14,2) AS amount, o_orderpriority = '1-URGENT' AS urgent FROM orders""",
    "trend_window": f"WITH {CASES} SELECT complaint_id, date_received FROM cases WHERE in_window",
    "volume_floor": f"""WITH {NAMED} SELECT company, sum(n_complaints)::BIGINT AS n_complaints FROM companies
GROUP BY company HAVING sum(n_complaints) >= {VOLUME_FLOOR}""",
    "issue_floor": f"""WITH {CASES} SELECT product_short, issue, count(*) AS complaints, count(*) FILTER (monetary) AS monetary_relief,
  {pct('count(*) FILTER (monetary)', 'count(*) FILTER (resolved)')} AS relief_rate
FROM cases WHERE in_window GROUP BY product_short, issue HAVING count(*) >= {FLOOR}""",
    "topn_per_group": f"""WITH {CASES} SELECT product, issue, count(*) AS complaints,
  row_number() OVER (PARTITION BY product ORDER BY count(*) DESC, issue) AS place
FROM cases WHERE in_window GROUP BY product, issue QUALIFY place <= 10""",
    "top_k_size_adjusted": f"""WITH {SUMMARY} SELECT company, complaints_per_1b_assets, volume_rank - size_adjusted_rank AS rank_gap,
  total_complaints, fdic_status FROM summary WHERE is_fdic_matched AND complaints_per_1b_assets IS NOT NULL
ORDER BY complaints_per_1b_assets DESC, company LIMIT 15""",
    "cross_filter": f"""WITH {SUMMARY} SELECT company, risk_tier, total_complaints, complaints_per_1b_assets FROM summary
WHERE is_fdic_matched AND risk_tier IN ('High', 'Severe')""",
    "date_parts": f"""WITH {RAW} SELECT complaint_id, received::DATE AS date_received, sent::DATE AS date_sent_to_company,
  year(received)::INTEGER AS "year", month(received)::INTEGER AS "month", strftime(received, '%Y-%m') AS year_month,
  date_trunc('month', received)::DATE AS month_start, day(received)::INTEGER AS "day" FROM raw""",
    "routing_lag": f"""WITH {RAW} SELECT complaint_id,
  round((epoch_us(sent) - epoch_us(received)) / 86400000000.0::DOUBLE, 3) AS days_to_company FROM raw""",
    "taxonomy_repair": f"""WITH {PREPARED} SELECT complaint_id, product_now AS product, sub_product, product_raw,
  legacy AS dq_legacy_product_label, coalesce({as_map(SHORT_LABELS)}[product_now], product_now) AS product_short FROM typed""",
    "normalise_key": f"""WITH {RAW} SELECT DISTINCT company_raw,
  regexp_replace(regexp_replace(trim(regexp_replace(upper(company_raw), '[^A-Z0-9]+', ' ', 'g')), '^THE ', ''),
    '( ({"|".join(LEGAL_FORMS)}))+$', '') AS company_key
FROM (SELECT trim(regexp_replace(company, '\\s+', ' ', 'g')) AS company_raw FROM raw)""",
    "match_normalise": f"WITH {NAMED} SELECT company, {_norm('company')} AS norm FROM companies",
    "sig_tokens": f"WITH {NAMED} SELECT company, array_to_string({_sig(_norm('company'))}, ' ') AS tokens FROM companies",
    "token_jaccard": """WITH w AS (SELECT doc_id, list_sort(list_distinct(list_filter(
  string_split_regex(text, '[^A-Za-z]+'), lambda t: length(t) >= 3))) AS s FROM documents)
SELECT a.doc_id, len(list_intersect(a.s, b.s)) AS shared,
  round((coalesce(len(list_intersect(a.s, b.s))::DOUBLE / nullif(len(list_distinct(list_concat(a.s, b.s))), 0), 0))::DOUBLE::DECIMAL(38, 12), 6)::DOUBLE AS jaccard,
  a.s = b.s AS same_set FROM w a JOIN w b ON b.doc_id = a.doc_id + 1""",
    "declared_class": f"""WITH {NAMED} SELECT company, {_DECLARED} AS method
FROM (SELECT company, {_norm('company')} AS norm FROM companies)""",
    "geo_classify": f"WITH {PREPARED} SELECT complaint_id, state, state_type, dq_state_missing FROM prepared",
    "zip_prefix": f"WITH {PREPARED} SELECT complaint_id, zip_code, zip3, dq_zip_masked FROM prepared",
    "sentinel_fill": f"""WITH {PREPARED} SELECT complaint_id, product_raw AS product, submitted_via, sub_issue, sub_product, issue,
  company_public_response, company_response, tags, timely FROM prepared""",
    "outcome_flags": f"""WITH {PREPARED} SELECT complaint_id, is_servicemember, is_older_american, is_resolved, got_monetary_relief,
  got_any_relief, closed_explanation_only, is_untimely, company_disputes_facts FROM prepared""",
    "dq_flags": f"""WITH {PREPARED} SELECT complaint_id, COLUMNS('^dq_.*'), in_trend_window FROM prepared""",
    "filtered_counts": f"""WITH {CASES} SELECT product, issue, count(*) AS n, count(*) FILTER (resolved) AS is_resolved,
  count(*) FILTER (monetary) AS got_monetary_relief, count(*) FILTER (untimely) AS is_untimely FROM cases GROUP BY product, issue""",
    "filtered_distinct": f"""WITH {CASES} SELECT company, count(DISTINCT product) AS products_touched,
  count(DISTINCT state) FILTER (state_type = 'state') AS states_touched FROM cases WHERE in_window GROUP BY company""",
    "filtered_avg": f"""WITH {CASES} SELECT company, {rnd('avg(days) FILTER (days <= 365)', 3)} AS avg_days_to_company
FROM cases GROUP BY company""",
    "group_percentiles": f"""WITH {CASES} SELECT company, {rnd('quantile_cont(days, 0.5)', 3)} AS p50,
  {rnd('quantile_cont(days, 0.9)', 3)} AS p90 FROM cases GROUP BY company""",
    "crosstab_outcome": f"""WITH {CASES} SELECT product_short, count(*) FILTER (monetary) AS monetary_relief,
  count(*) FILTER (NOT monetary) AS no_monetary_relief FROM cases WHERE resolved GROUP BY product_short""",
    "yearly_growth": f"""WITH {CASES}, y AS (SELECT product, count(*) FILTER ("year" = 1996) AS n_first,
  count(*) FILTER ("year" = 2000) AS n_last FROM cases WHERE in_window AND "year" IN (1996, 2000) GROUP BY product)
SELECT *, {pct('n_last - n_first', 'n_first')} AS growth_pct FROM y""",
    "edge_growth": f"""WITH {MONTHLY}, placed AS (SELECT product_short, complaints,
  row_number() OVER (PARTITION BY product_short ORDER BY year_month) AS up,
  row_number() OVER (PARTITION BY product_short ORDER BY year_month DESC) AS down FROM monthly), means AS (
SELECT product_short, avg(complaints) FILTER (up <= 3) AS f, avg(complaints) FILTER (down <= 3) AS l FROM placed GROUP BY 1)
SELECT product_short, {rnd('f', 4)} AS first_mean, {rnd('l', 4)} AS last_mean, {pct('l - f', 'f')} AS growth_pct FROM means""",
    "national_baseline": f"""WITH {CASES}, g AS (SELECT product, count(*) AS resolved, """
    + ", ".join(f"count(*) FILTER ({c}) AS {n}_n" for n, c in _BASELINE.items())
    + """ FROM cases WHERE in_window AND resolved GROUP BY product), a AS (SELECT *, sum(resolved) OVER () AS t_resolved, """
    + ", ".join(f"sum({n}_n) OVER () AS t_{n}" for n in _BASELINE)
    + f" FROM g) SELECT product, resolved, {_BASELINE_COLUMNS} FROM a",
    "clean_metrics": f"WITH {PREPARED} "
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, ({x})::DOUBLE AS value FROM prepared" for m, x in _METRICS.items()),
    "null_profile": f"WITH {PREPARED} "
    + _column_rows("prepared", _CLEAN_COLUMNS, 'count(*) FILTER ("{c}" IS NULL) AS nulls'),
    "before_after": f"""WITH {CLEAN} SELECT 'before' AS stage, 16::INTEGER AS column_count, count(*) AS row_count,
  count(*) FILTER (sub_product IS NULL) + count(*) FILTER (issue IS NULL) + count(*) FILTER (sub_issue IS NULL)
  + count(*) FILTER (state IS NULL) + count(*) FILTER (zip_code IS NULL) + count(*) FILTER (tags IS NULL)
  + count(*) FILTER (public_response IS NULL) + count(*) FILTER (response IS NULL) + count(*) FILTER (timely IS NULL)
    AS total_nulls, count(DISTINCT company) AS distinct_companies, count(DISTINCT product) AS distinct_products FROM raw
UNION ALL SELECT 'after', 43, count(*), 6 * count(*) FILTER (date_received IS NULL) + count(*) FILTER (zip3 IS NULL),
  count(DISTINCT company), count(DISTINCT product) FROM clean""",
    "canonical_name": f"WITH {PREPARED} SELECT company_key, company_clean, spellings, n_complaints FROM canon",
    "name_map": f"""WITH {PREPARED} SELECT s.company_raw, c.company_clean, company_key, s.n AS n_complaints,
  c.spellings > 1 AS required_collapse FROM spelled s JOIN canon c USING (company_key)""",
    "business_dedupe": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::DATE AS l_shipdate, l_extendedprice,
  nullif(l_tax, 0) AS l_tax, nullif(l_discount, 0) AS l_discount FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY (l_tax <> 0)::INT + (l_discount <> 0)::INT DESC,
  lineitem.l_shipdate, l_partkey, l_suppkey, l_extendedprice) = 1""",
    "date_only_repeats": """SELECT sum(n)::BIGINT AS row_count, count(*) AS distinct_keys, sum(n - 1)::BIGINT AS repeats
FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type, ts::DATE)""",
    "clean_facts": f"""WITH {CLEAN} SELECT * REPLACE (strftime(date_received_ts, '%Y-%m-%d %H:%M:%S') AS date_received_ts) FROM clean""",
    "volume_quartile": f"""WITH {CASES} SELECT company, count(*) AS complaints,
  ntile(4) OVER (ORDER BY count(*) DESC, company) AS volume_quartile FROM cases WHERE in_window GROUP BY company""",
    "centred_average": f"""WITH {OVERALL} SELECT year_month, complaints, CASE WHEN count(*) OVER w = 3
  THEN round((avg(complaints) OVER w)::DOUBLE::DECIMAL(38, 12), 4)::DOUBLE END AS centred_avg FROM overall
WINDOW w AS (ORDER BY year_month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""",
    "pct_rank": f"""WITH {NAMED}, c AS (SELECT company, sum(n_complaints)::BIGINT AS n_complaints FROM companies GROUP BY company),
r AS (SELECT *, (rank() OVER (ORDER BY n_complaints) + (count(*) OVER (PARTITION BY n_complaints) - 1) / 2.0::DOUBLE)
  / count(*) OVER () AS p FROM c)
SELECT company, n_complaints, {rnd('100.0::DOUBLE * p', 2)} AS pctile, {rnd('100.0::DOUBLE * (1.0::DOUBLE - p)', 2)} AS pctile_reversed FROM r""",
    "spearman_matrix": f"WITH {ENRICHED}, m AS (SELECT * FROM enriched WHERE matched AND {_SCORED}) " + _spearman("m", _UPPER),
    "rank_contrast": f"""WITH {ENRICHED}, m AS (SELECT company, total_complaints, complaints_per_1b_assets,
  rank() OVER (ORDER BY total_complaints DESC) AS volume_rank,
  CASE WHEN complaints_per_1b_assets IS NOT NULL
    THEN rank() OVER (PARTITION BY complaints_per_1b_assets IS NULL ORDER BY complaints_per_1b_assets DESC) END AS size_rank
  FROM enriched WHERE matched AND {_SCORED}) SELECT *, volume_rank - size_rank AS gap FROM m""",
    "top_k_global": f"""WITH {NAMED} SELECT company, sum(n_complaints)::BIGINT AS n_complaints FROM companies
GROUP BY company ORDER BY 2 DESC, company LIMIT 15""",
    "peak_period": f"""WITH {OVERALL} SELECT year_month AS peak_period, complaints AS peak_value FROM overall
ORDER BY complaints DESC, year_month LIMIT 1""",
    "window_change": f"""WITH {OVERALL}, e AS (SELECT arg_min(complaints, year_month) AS first_value,
  arg_max(complaints, year_month) AS last_value FROM overall)
SELECT *, {pct('last_value - first_value', 'first_value')} AS pct_change FROM e""",
    "chi_square_product": _chi_square("product_short"),
    "chi_square_company": _chi_square("company", RESOLVED_FLOOR),
    # The upper tail is one minus the series of the incomplete gamma function.
    "chi_square_p_value": f"""WITH test AS ({_chi_square("company", RESOLVED_FLOOR)})
SELECT *, round((1 - (SELECT sum(exp((dof / 2.0 + k) * ln(statistic / 2) - statistic / 2 - lgamma(dof / 2.0 + k + 1)))
  FROM range(20000) r(k)))::DECIMAL(38, 12), 9)::DOUBLE AS p_value FROM test""",
    "large_groups": f"""WITH {CASES} SELECT complaint_id, company FROM cases WHERE resolved
QUALIFY count(*) OVER (PARTITION BY company) >= {RESOLVED_FLOOR}""",
    "chi_residuals": f"""WITH {_outcome_table('company', RESOLVED_FLOOR)}, z AS (
SELECT g AS company, outcome, o AS observed, round((e)::DOUBLE::DECIMAL(38, 12), 6)::DOUBLE AS expected, round(((o - e) / sqrt(e))::DOUBLE::DECIMAL(38, 12), 6)::DOUBLE AS residual
FROM scored), ends AS (SELECT *, row_number() OVER (ORDER BY residual, company, outcome) AS low,
  row_number() OVER (ORDER BY residual DESC, company, outcome) AS high FROM z), picked AS (
SELECT * FROM ends WHERE low <= 4 UNION ALL SELECT * FROM ends WHERE high <= 4)
SELECT company, outcome, observed, expected, residual, CASE WHEN residual > 0 THEN 'MORE than expected'
  ELSE 'FEWER than expected' END AS direction, abs(residual) > 2 AS beyond_two FROM picked""",
    "rate_spread": f"""WITH {_outcome_table('company', RESOLVED_FLOOR)}, x AS (
SELECT g, {pct('yes', 'yes + no', 6)} AS rate FROM wide)
SELECT count(*) AS groups, min(rate) AS min_rate, arg_min(g, (rate, g)) AS min_group, {rnd('median(rate)', 6)} AS median_rate,
  max(rate) AS max_rate, arg_min(g, (-rate, g)) AS max_group, {div('max(rate)', 'greatest(median(rate), 0.01)', 4)} AS max_to_median FROM x""",
    "spike_attribution": f"""WITH {CASES}, d AS (SELECT company, count(*) FILTER (year_month = '1998-04') AS n_after,
  count(*) FILTER (year_month = '1998-03') AS n_before FROM cases WHERE in_window AND year_month IN ('1998-03', '1998-04') GROUP BY company)
SELECT company, n_after, n_before, n_after - n_before AS increase, (sum(n_after - n_before) OVER ())::BIGINT AS spike_size,
  {pct('n_after - n_before', 'sum(n_after - n_before) OVER ()', 1)} AS pct_of_spike FROM d
ORDER BY n_after - n_before DESC, company LIMIT 6""",
    "spike_daily": """WITH d AS (SELECT ts::DATE AS "day", count(*) AS n FROM events GROUP BY 1)
SELECT arg_min("day", (-n, "day")) AS peak_day, max(n) AS peak_n, median(n)::DOUBLE AS median_day_n, count(*) AS days FROM d""",
    "spike_categories": f"""WITH {CASES} SELECT product_short, issue, count(*) AS n FROM cases WHERE in_window AND year_month = '1998-04'
GROUP BY ALL ORDER BY n DESC, product_short, issue LIMIT 4""",
    "sensitivity": f"WITH {_SENSITIVE} SELECT *, rank_with = rank_without AS keeps_rank FROM shifts",
    "sensitivity_summary": f"""WITH {_SENSITIVE} SELECT count(*) AS companies, count(*) FILTER (rank_with = rank_without) AS keeping_rank,
  count(*) FILTER (pct_from_month > 1.5) AS material FROM shifts""",
    "score_redundancy": f"WITH {RATES}, m AS (SELECT * FROM rates WHERE {_SCORED}) "
    + _spearman(
        "m",
        [("pct_no_relief", "explanation_only_rate")],
        ", (SELECT round((avg(abs(pct_no_relief - explanation_only_rate)))::DOUBLE::DECIMAL(38, 12), 4)::DOUBLE FROM m) AS mean_gap",
    ),
    "holding_rollup": f"""WITH {INSTITUTIONS}, top AS (
SELECT * FROM inst QUALIFY row_number() OVER (PARTITION BY group_key ORDER BY asset DESC, cert::VARCHAR) = 1)
SELECT group_key, g.group_name, total_assets_k, n_charters, top.name AS largest_charter,
  top.asset::DECIMAL(20,2) AS largest_charter_assets_k, top.cert::VARCHAR AS primary_cert, top.stalp AS state,
  has_holding_company, total_assets_b,
  CASE WHEN total_assets_k > 0 THEN round((100.0::DOUBLE * (1 - top.asset::DOUBLE / total_assets_k::DOUBLE))::DOUBLE::DECIMAL(38, 12), 2)::DOUBLE END
    AS assets_understated_pct FROM grp g JOIN top USING (group_key)""",
    "match_candidates": f"WITH {CANDIDATES} SELECT norm, group_key, source FROM candidates",
    "entity_match": f"WITH {MATCHES} SELECT * FROM matches",
    "match_breakdown": f"""WITH {MATCHES} SELECT match_method, count(*) AS companies, sum(n_complaints)::BIGINT AS complaints,
  {pct('sum(n_complaints)', '(SELECT sum(n_complaints) FROM matches)')} AS pct_of_volume FROM matches GROUP BY match_method""",
    "match_rate": f"""WITH {MATCHES}, s AS (SELECT count(*) AS companies, count(*) FILTER (matched) AS matched_companies,
  sum(n_complaints)::BIGINT AS complaints, coalesce(sum(n_complaints) FILTER (matched), 0)::BIGINT AS matched_complaints FROM matches)
SELECT *, {pct('matched_companies', 'companies', 1)} AS pct_companies, {pct('matched_complaints', 'complaints', 1)} AS pct_volume FROM s""",
    "filtered_distinct_sketched": f"""WITH {CASES}, scope AS (SELECT company, product, CASE WHEN state_type = 'state' THEN state END AS home
  FROM cases WHERE in_window)
SELECT 'company' AS level, company, NULL::VARCHAR AS product, count(DISTINCT product) AS products_touched,
  count(DISTINCT home) AS states_touched FROM scope GROUP BY company
UNION ALL SELECT 'product', NULL, product, count(DISTINCT product), count(DISTINCT home) FROM scope GROUP BY product
UNION ALL SELECT 'nation', NULL, NULL, count(DISTINCT product), count(DISTINCT home) FROM scope""",
    "near_misses": f"""WITH {MATCHES} SELECT company, cand AS candidate, shared, {rnd('jaccard', 6)} AS jaccard, {rnd('score', 1)} AS score
FROM name_scores WHERE score >= 75""",
    "unmatched_top": f"""WITH {MATCHES} SELECT company, n_complaints, match_method FROM matches WHERE NOT matched
ORDER BY n_complaints DESC, company LIMIT 20""",
    "review_band": f"""WITH {MATCHES} SELECT company, n_complaints, match_method, match_score FROM matches WHERE match_method = 'below_threshold'""",
    "company_enriched": f"WITH {ENRICHED} SELECT * FROM enriched",
    "plausibility_sweep": f"""WITH {ENRICHED} SELECT company, fdic_name, total_complaints, total_assets_b, complaints_per_1b_assets
FROM enriched WHERE matched AND complaints_per_1b_assets > 300""",
    "company_features": f"""WITH {RATES} SELECT company, total_complaints, products_touched, states_touched, first_complaint, last_complaint,
  servicemember_complaints, older_american_complaints, with_narrative, avg_days_to_company, median_days_to_company,
  p90_days_to_company FROM base""",
    "company_outcomes": f"""WITH {RATES} SELECT company, resolved_complaints, monetary_relief_n, any_relief_n, explanation_only_n,
  untimely_n, disputes_facts_n FROM base WHERE resolved_complaints > 0""",
    "company_rates": f"""WITH {RATES} SELECT company, matched, monetary_relief_rate, any_relief_rate, pct_no_relief, explanation_only_rate,
  untimely_rate, disputes_facts_rate, pct_servicemember, pct_older_american, complaints_per_1b_assets FROM rates""",
    "conduct_score": f"""WITH {PROFILE} SELECT company, total_complaints, pctile_pct_no_relief, pctile_untimely_rate,
  pctile_disputes_facts_rate, pctile_avg_days_to_company, conduct_risk_score FROM profile""",
    "exposure_score": f"""WITH {PROFILE} SELECT company, conduct_risk_score, pctile_complaints_per_1b_assets, exposure_risk_score FROM profile""",
    "risk_tier": f"WITH {PROFILE} SELECT company, conduct_risk_score, risk_tier FROM profile",
    "risk_profile": f"WITH {PROFILE} SELECT * FROM profile",
    "tier_distribution": f"""WITH {PROFILE}, t AS (SELECT risk_tier, count(*) AS companies, sum(total_complaints)::BIGINT AS complaints
  FROM profile WHERE risk_tier IS NOT NULL GROUP BY risk_tier)
SELECT *, {pct('companies', 'sum(companies) OVER ()', 1)} AS pct_of_companies FROM t""",
    "component_spread": f"WITH {RATES}, m AS (SELECT * FROM rates WHERE {_SCORED}) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS component, {w}::DOUBLE AS weight, {rnd(f'quantile_cont({c}, 0.5)', 3)} AS median, "
        f"{rnd(f'quantile_cont({c}, 0.9)', 3)} AS p90 FROM m"
        for c, w in (("pct_no_relief", 0.4), ("untimely_rate", 0.35), ("disputes_facts_rate", 0.15), ("avg_days_to_company", 0.1))
    ),
    "q01_company_ranking": f"""WITH {CASES}, v AS (
SELECT company, count(*) AS complaints, count(*) FILTER (resolved) AS resolved, count(*) FILTER (monetary) AS m,
  count(*) FILTER (untimely) AS u, count(DISTINCT product) AS products_touched,
  count(DISTINCT state) FILTER (state_type = 'state') AS states_touched, min(date_received) AS first_complaint,
  max(date_received) AS last_complaint FROM cases WHERE in_window GROUP BY company)
SELECT rank() OVER (ORDER BY complaints DESC) AS volume_rank, dense_rank() OVER (ORDER BY complaints DESC) AS volume_dense_rank,
  company, complaints, {pct('complaints', 'sum(complaints) OVER ()', 4)} AS pct_of_all_complaints,
  {pct('sum(complaints) OVER (ORDER BY complaints DESC, company ROWS UNBOUNDED PRECEDING)', 'sum(complaints) OVER ()')} AS cumulative_pct,
  resolved, {pct('m', 'resolved')} AS monetary_relief_rate, {pct('u', 'resolved')} AS untimely_rate, products_touched,
  states_touched, first_complaint, last_complaint FROM v QUALIFY volume_rank <= 100""",
    "q02_monthly_trend": f"WITH {MONTHLY} {_trend('monthly')}",
    "q02_dense_trend": f"""WITH {CASES}, sparse AS (
SELECT product || ' / ' || state || ' / ' || issue AS product, year_month, min(date_received) AS month_start, count(*) AS complaints,
  count(*) FILTER (resolved) AS resolved, count(*) FILTER (monetary) AS monetary_relief,
  count(*) FILTER (untimely) AS untimely FROM cases WHERE in_window GROUP BY 1, 2), spine AS (
SELECT product, unnest(range(min(strptime(year_month || '-01', '%Y-%m-%d')),
  max(strptime(year_month || '-01', '%Y-%m-%d')) + INTERVAL 1 DAY, INTERVAL 1 MONTH))::DATE AS d FROM sparse GROUP BY product), dense AS (
SELECT p.product, p.product AS product_short, strftime(d, '%Y-%m') AS year_month, coalesce(month_start, d) AS month_start,
  coalesce(complaints, 0) AS complaints, coalesce(monetary_relief, 0) AS monetary_relief, coalesce(untimely, 0) AS untimely
FROM spine p LEFT JOIN sparse s ON s.product = p.product AND s.year_month = strftime(d, '%Y-%m'))
{_trend('dense')}""",
    "q03_resolution": f"""WITH {CASES}, r AS (SELECT company, count(*) AS resolved_complaints,
  {pct('count(*) FILTER (monetary)', 'count(*)', 3)} AS monetary_relief_rate, {pct('count(*) FILTER (any_relief)', 'count(*)', 3)} AS any_relief_rate,
  {pct('count(*) FILTER (explained)', 'count(*)', 3)} AS explanation_only_rate, {pct('count(*) FILTER (untimely)', 'count(*)', 3)} AS untimely_rate,
  {pct('count(*) FILTER (disputes)', 'count(*)', 3)} AS disputes_facts_rate,
  {rnd('avg(days) FILTER (days <= 365)', 3)} AS avg_days_to_company
FROM cases WHERE in_window AND resolved GROUP BY company HAVING count(*) >= {RESOLVED_FLOOR}), m AS (
SELECT median(monetary_relief_rate) AS mr, median(untimely_rate) AS mu FROM r)
SELECT r.*, rank() OVER (ORDER BY monetary_relief_rate) AS worst_relief_rank,
  rank() OVER (ORDER BY untimely_rate DESC) AS worst_timeliness_rank,
  {rnd('percent_rank() OVER (ORDER BY monetary_relief_rate)', 4)} AS relief_percentile_worst_first,
  {rnd('percent_rank() OVER (ORDER BY untimely_rate DESC)', 4)} AS untimely_percentile_worst_first,
  {rnd('mr', 3)} AS peer_median_relief_rate, {rnd('monetary_relief_rate - mr', 3)} AS relief_rate_vs_median,
  {rnd('untimely_rate - mu', 3)} AS untimely_rate_vs_median FROM r, m""",
    "q04_size_adjusted": f"""WITH {ENRICHED}, o AS (SELECT company, count(*) FILTER (resolved) AS resolved, count(*) FILTER (monetary) AS m,
  count(*) FILTER (untimely) AS u FROM cases WHERE in_window GROUP BY company), c AS (
SELECT company, fdic_name, n_charters, match_method, total_complaints, total_assets_b, complaints_per_1b_assets, o.resolved,
  {pct('o.m', 'o.resolved', 3)} AS monetary_relief_rate, {pct('o.u', 'o.resolved', 3)} AS untimely_rate
FROM enriched JOIN o USING (company) WHERE matched AND total_assets_b > 0 AND {_SCORED}), k AS (
SELECT *, rank() OVER (ORDER BY total_complaints DESC) AS volume_rank,
  rank() OVER (ORDER BY complaints_per_1b_assets DESC) AS size_adjusted_rank, avg(complaints_per_1b_assets) OVER () AS a FROM c)
SELECT * EXCLUDE (a), volume_rank - size_adjusted_rank AS rank_gap,
  CASE WHEN volume_rank - size_adjusted_rank >= 5 THEN 'UNDERSTATED by volume'
    WHEN volume_rank - size_adjusted_rank <= -5 THEN 'overstated by volume' ELSE 'consistent' END AS volume_vs_size_verdict,
  {div('complaints_per_1b_assets', 'a', 2)} AS x_peer_average, {rnd('a', 3)} AS peer_avg_rate FROM k""",
    "q05_top_issues": f"""WITH {CASES}, pi AS (SELECT product, product_short, issue, count(*) AS complaints, count(*) FILTER (resolved) AS resolved,
  count(*) FILTER (monetary) AS monetary_relief, count(*) FILTER (untimely) AS u, count(*) FILTER (servicemember) AS sm,
  count(*) FILTER (older) AS oa FROM cases WHERE in_window GROUP BY ALL HAVING count(*) >= {FLOOR}), s AS (
SELECT *, (sum(complaints) OVER (PARTITION BY product))::BIGINT AS product_total,
  row_number() OVER (PARTITION BY product ORDER BY complaints DESC, issue) AS rank_by_volume,
  row_number() OVER (PARTITION BY product ORDER BY monetary_relief DESC, issue) AS rank_by_relief_count FROM pi)
SELECT product, product_short, rank_by_volume, issue, complaints, {pct('complaints', 'product_total')} AS pct_of_product, product_total,
  resolved, monetary_relief, {pct('monetary_relief', 'resolved')} AS relief_rate, {pct('u', 'resolved')} AS untimely_rate,
  {pct('sm', 'complaints')} AS pct_servicemember, {pct('oa', 'complaints')} AS pct_older_american, rank_by_relief_count,
  rank_by_volume - rank_by_relief_count AS volume_vs_relief_rank_gap FROM s WHERE rank_by_volume <= 10""",
    "q06_state_profile": f"""WITH {STATES} SELECT rank() OVER (ORDER BY complaints DESC) AS volume_rank, t.state, complaints,
  {pct('complaints', 'sum(complaints) OVER ()', 3)} AS pct_of_national, companies AS companies_complained_about, i.issue AS top_issue,
  i.n AS top_issue_complaints, {pct('i.n', 'complaints')} AS top_issue_pct, p.product_short AS top_product,
  {pct('p.n', 'complaints')} AS top_product_pct, {pct('m', 'resolved')} AS monetary_relief_rate, {pct('u', 'resolved')} AS untimely_rate,
  avg_days_to_company, {rnd('100.0::DOUBLE * m / resolved - 100.0::DOUBLE * sum(m) OVER () / sum(resolved) OVER ()', 2)} AS relief_rate_vs_national
FROM totals t JOIN by_issue i USING (state) JOIN by_product p USING (state)""",
    "v_company_summary": f"WITH {SUMMARY} SELECT *, volume_rank - size_adjusted_rank AS rank_gap FROM summary",
    "v_complaints_enriched": f"""WITH {PROFILE} SELECT complaint_id, date_received, "year", "month", year_month, product, product_short, sub_product,
  issue, sub_issue, c.company, state, state_type, CASE WHEN regexp_matches(left(zip_code, 3), '^[0-9]{{3}}$') THEN left(zip_code, 3) END AS zip3,
  submitted_via, response AS company_response,
  CASE WHEN disputes THEN '{DISPUTED}' ELSE 'No public response provided' END AS company_public_response,
  CASE WHEN untimely THEN 'No' ELSE 'Yes' END AS timely, tags, servicemember AS is_servicemember, older AS is_older_american,
  narrative AS has_narrative, days AS days_to_company, resolved AS is_resolved, monetary AS got_monetary_relief,
  c.any_relief AS got_any_relief, untimely AS is_untimely, explained AS closed_explanation_only, p.matched AS is_fdic_matched,
  p.fdic_name, p.total_assets_b, conduct_risk_score, exposure_risk_score, risk_tier
FROM cases c LEFT JOIN profile p ON p.company = c.company WHERE in_window""",
    "v_monthly_trend": f"""WITH {MONTHLY} SELECT *, {pct('monetary_relief', 'resolved')} AS monetary_relief_rate,
  {pct('untimely', 'resolved')} AS untimely_rate, lag(complaints) OVER w AS prev_month,
  {pct('complaints - lag(complaints) OVER w', 'lag(complaints) OVER w')} AS mom_pct_change,
  round((avg(complaints) OVER (PARTITION BY product ORDER BY year_month ROWS 2 PRECEDING))::DOUBLE::DECIMAL(38, 12), 1)::DOUBLE AS moving_avg_3m
FROM monthly WINDOW w AS (PARTITION BY product ORDER BY year_month)""",
    "v_state_summary": f"""WITH {STATES} SELECT t.state, complaints, companies, {pct('complaints', 'sum(complaints) OVER ()', 3)} AS pct_of_national,
  {pct('m', 'resolved')} AS monetary_relief_rate, {pct('u', 'resolved')} AS untimely_rate, avg_days_to_company, i.issue AS top_issue,
  p.product_short AS top_product FROM totals t JOIN by_issue i USING (state) JOIN by_product p USING (state)""",
    "monthly_overall": f"""WITH {OVERALL} SELECT *, (year_month || '-01')::DATE AS month_dt, {pct('monetary_relief', 'resolved', 4)} AS relief_rate,
  {pct('untimely', 'resolved', 4)} AS untimely_rate FROM overall""",
    "resolution_quadrant": f"""WITH {SUMMARY}, m AS (SELECT median(monetary_relief_rate) AS mr, median(untimely_rate) AS mu FROM summary)
SELECT company, total_complaints, monetary_relief_rate, untimely_rate, {rnd('mr', 3)} AS median_relief_rate,
  {rnd('mu', 3)} AS median_untimely_rate, CASE WHEN monetary_relief_rate IS NULL OR untimely_rate IS NULL THEN NULL
    WHEN monetary_relief_rate < mr AND untimely_rate > mu THEN 'low relief, late'
    WHEN monetary_relief_rate < mr THEN 'low relief, on time' WHEN untimely_rate > mu THEN 'high relief, late'
    ELSE 'high relief, on time' END AS quadrant FROM summary, m""",
    "integrity_checks": f"""WITH {CASES} SELECT 'row_count' AS check_name, count(*) = (SELECT count(*) FROM lineitem) AS passed FROM cases
UNION ALL SELECT 'complaint_id_unique', count(*) = count(DISTINCT complaint_id) FROM cases
UNION ALL SELECT 'zip3_keeps_leading_zeros', count(*) > 0 FROM cases WHERE zip_code LIKE '0%'
UNION ALL SELECT 'dates_are_dates', bool_and(typeof(date_received) = 'DATE') FROM cases
UNION ALL SELECT 'flags_are_booleans', bool_and(typeof(monetary) = 'BOOLEAN') FROM cases
UNION ALL SELECT 'dates_inside_window', count(*) = 0 FROM cases WHERE date_received < DATE '1995-01-01' OR date_received > DATE '{TREND_END}'
UNION ALL SELECT 'every_company_known', count(*) = 0 FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""",
    "cross_filter_facts": f"""WITH {CASES} SELECT complaint_id, product_short, state, year_month, company FROM cases
WHERE product IN ('ECONOMY', 'PROMO') AND state IN (SELECT n_name FROM nation WHERE n_nationkey < 5)
  AND year_month BETWEEN '1996-02' AND '1997-05'""",
    "cross_filter_company": f"""WITH {CASES} SELECT complaint_id, year_month, company FROM cases WHERE company = 'CITIBANK, N.A.'""",
    "sample_extract": """SELECT o_orderkey::VARCHAR AS complaint_id, o_orderpriority, o_orderstatus FROM orders
ORDER BY o_orderkey LIMIT 1000""",
    "replace_table": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderstatus",
    "named_views": f"""WITH {CASES} SELECT (SELECT count(DISTINCT year_month) FROM cases WHERE in_window) AS months,
  (SELECT count(DISTINCT state) FROM cases WHERE in_window AND state_type = 'state') AS states""",
    "query_runner": f"""WITH {CASES} SELECT 'national_baseline' AS name, count(DISTINCT product) AS row_count, NULL::VARCHAR AS failure
FROM cases WHERE in_window AND resolved UNION ALL SELECT 'monthly_overall', count(DISTINCT year_month), NULL FROM cases WHERE in_window
UNION ALL SELECT 'failing', 0, 'no such report'""",
}


ORACLES["clean_log"] = ORACLES["clean_metrics"]
ORACLES["ingest_history"] = """WITH e AS (SELECT CASE WHEN event_id % 97 <> 5 THEN event_id END AS event_id, event_type FROM events)
SELECT CASE WHEN event_id % 3 <> 0 THEN 1 ELSE 2 END AS run, event_id, event_type FROM e WHERE event_id IS NOT NULL"""
