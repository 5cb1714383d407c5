"""Personal data: base patterns, and terms that disclose what the patterns protect.

Base. Four kinds of spans are matched leftmost and without overlap, each over the whole
text; matches that fail their check are dropped. The patterns are written with possessive
parts and run starts, which match what the plain ones do in time linear in the text.

Information-theoretic sanitisation. A protected entity is the text of a base span, and, as most
of those stand in one or two places only, the group it belongs to: the domain of an address, the
network of a number of a machine, the first digits of a card or a phone. The terms in the five
words to either side are counted: how often a term stands near the entity, against how often
it stands anywhere in the corpus. The pointwise mutual information of term and entity, as a
share of the entity's information content, tells how far the term alone discloses the
entity: 1 for a term that occurs near it only. Counts cover all documents. A pair counts as
evidence if it stands in a number of different contexts, so that copies of one text are none,
or if the term stands nowhere in the corpus but near the entity. In the documents where such a
term stands near its entity, all its occurrences are removed above one threshold and
generalised to their word shape above a lower one.

Positions of matches come from the lengths of the pieces between them, summed by a window
per document and kind over narrow rows: code points, end exclusive.

Defined cases: a null text is empty; a text without a match has no span and the hash of the
empty string; repeated rows give equal rows each; a text with any number of matches is
handled row by row; an empty table gives no rows. The result keeps the id and text only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plaintide.llm.common import same, shuffle_tasks, whole_text
from plaintide.session import settle

#: Kinds in their order, with patterns equal in matches to the plain ones.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
#: A word of letters that is no part of an address or of a name with digits.
TERM = r"(?<![\p{L}\p{N}@._%+-])\p{L}++(?![\p{N}@_%+-]|\.[\p{L}\p{N}])"
#: Up to so many words next to a match, from the start of the text behind it (or of the reversed text before it).
REACH = r"^\s*+(?:\S++\s*+){0,5}"
#: What entities of a kind have in common.
GROUPS = {"email": r"@(.*)$", "ip": r"^([0-9]+\.[0-9]+\.[0-9]+)\.", "card": r"^([0-9]{6})", "phone": r"^([0-9]{5})"}
EVIDENCE = 3
REMOVE_ABOVE = 0.9
GENERALISE_ABOVE = 0.8
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_KEY = ["doc_id", "text_hash"]
_BLOCK = 256


def _luhn(digits: Column) -> Column:
    """Whether a string of 14 to 19 digits has a right check digit."""
    backwards = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substring(backwards, i + 1, F.lit(1)).cast("int") * (1 + i % 2)
        return d - F.when(d > 9, 9).otherwise(0)

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + value(i))
    return F.when(F.length(digits).between(14, 19), total % 10 == 0).otherwise(False)


def _holds(kind: Column, value: Column) -> Column:
    """Whether a match of that kind passes its check."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(kind == "ip", value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
        .when(kind == "card", _luhn(digits))
        .when(kind == "phone", F.length(digits).between(10, 15))
        .otherwise(True)
    )


def _matches(kind: str, pattern: str) -> tuple[Column, Column]:
    """All matches of a pattern, and the pieces around them."""
    text = F.col("text")
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    if kind == "email":
        found = F.when(text.contains("@"), found).otherwise(F.expr("cast(array() AS array<string>)"))
        pieces = F.when(text.contains("@"), pieces).otherwise(F.array(text))
    if kind == "phone":
        found = F.when(text.contains("+"), found).otherwise(F.expr("cast(array() AS array<string>)"))
        pieces = F.when(text.contains("+"), pieces).otherwise(F.array(text))
    return found, pieces


def _placed(matches: DataFrame) -> DataFrame:
    """Matches (key, kind, at, value, gap, ...) with start and end."""
    before = Window.partitionBy(*_KEY, "kind").orderBy("at")
    end = F.sum(F.col("gap") + F.length("value")).over(before)
    return matches.withColumn("end", end.cast("bigint")).withColumn("start", F.col("end") - F.length("value"))


def _row(kind: str, pieces: Column):
    """A match and its place to a row; ``pieces`` are the parts of the text around the matches."""

    def row(value: Column, i: Column) -> Column:
        left, right = F.get(pieces, i), F.get(pieces, i + 1)
        return F.struct(
            F.lit(kind).alias("kind"), i.alias("at"), value.alias("value"), F.length(left).alias("gap"),
            _terms(F.reverse(F.regexp_extract(F.reverse(left), REACH, 0))).alias("before"),
            _terms(F.regexp_extract(right, REACH, 0)).alias("behind"),
        )

    return row


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def base_matches(documents: DataFrame) -> DataFrame:
    """Rows of base spans, and one row without kind for every document.

    Columns: doc_id, text_hash, copies (rows that repeat the document), n_terms, kind, at,
    value, start, end, before and behind (the terms next to the match).
    """
    docs = documents.select("doc_id", whole_text().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    lists = docs.withColumn("n_terms", F.regexp_count("text", F.lit(TERM)).cast("bigint"))
    for kind, pattern in PATTERNS.items():
        found, pieces = _matches(kind, pattern)
        lists = lists.withColumn(f"_m_{kind}", found).withColumn(f"_p_{kind}", pieces)
    none = F.expr("cast(array() AS array<string>)")
    empty = F.struct(
        F.lit(None).cast("string").alias("kind"), F.lit(-1).alias("at"), F.lit("").alias("value"), F.lit(0).alias("gap"),
        none.alias("before"), none.alias("behind"),
    )
    rows = [F.array(empty), *[F.transform(f"_m_{kind}", _row(kind, F.col(f"_p_{kind}"))) for kind in PATTERNS]]
    flat = lists.select(*_KEY, "n_terms", F.inline(F.concat(*rows)))
    # Rows that repeat a document are counted in the map tasks and go on as one.
    once = flat.groupBy(*_KEY, "kind", "at").agg(
        F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n_terms", "value", "gap", "before", "behind")]
    )
    tasks = shuffle_tasks(documents.sparkSession)
    placed = _placed(once.repartition(tasks, *_KEY))
    return placed.where(F.col("kind").isNull() | _holds(F.col("kind"), F.col("value"))).drop("gap")


def _group(kind: Column, value: Column) -> Column:
    """The group of an entity, by its digits where it is a card or a phone; empty where it has none."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    found = F.lit("")
    for name, pattern in GROUPS.items():
        text = digits if name in ("card", "phone") else F.lower(value)
        found = F.when(kind == name, F.regexp_extract(text, pattern, 1)).otherwise(found)
    return found


def near_terms(matches: DataFrame) -> DataFrame:
    """Rows (key, copies, entity, term, context): the terms next to every base span, for the span and for its group."""
    kind, value = F.col("kind"), F.col("value")
    entities = F.array(F.xxhash64(F.lit("one"), kind, value), F.xxhash64(F.lit("group"), kind, _group(kind, value)))
    rows = matches.where("kind IS NOT NULL").select(
        *_KEY, "copies", F.explode(entities).alias("entity"), F.xxhash64("before", "behind").alias("context"),
        F.concat("before", "behind").alias("terms"),
    )
    return rows.select(*_KEY, "copies", "entity", "context", F.explode("terms").alias("term"))


def disclosing(documents: DataFrame, near: DataFrame, n_terms: int | Column, evidence: int = EVIDENCE) -> DataFrame:
    """Rows (entity, term, disclosure) of pairs with evidence: pointwise mutual information over information content."""
    pairs = near.groupBy("entity", "term", "context").agg(F.sum("copies").alias("n"))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("n").alias("together"), F.count("*").alias("contexts"))
    around = near.groupBy("entity").agg(F.sum("copies").alias("around"))
    pairs = settle(pairs.join(around, "entity"), "pii-pairs")
    # Counted in the map tasks: what is shuffled is each task's distinct terms, whether few or many of them are asked for.
    words = documents.select(F.explode(_terms(whole_text())).alias("term"))
    counts = words.groupBy("term").agg(F.count("*").alias("anywhere"))
    content = F.log2(F.greatest(n_terms / F.col("around"), F.lit(2.0)))
    mutual = F.log2(F.col("together") * n_terms / (F.col("anywhere") * F.col("around").cast("double")))
    told = pairs.join(counts, "term").where((F.col("contexts") >= evidence) | (F.col("together") >= F.col("anywhere")))
    return told.select("entity", "term", (mutual / content).alias("disclosure"))


def term_spans(documents: DataFrame, marked: DataFrame) -> DataFrame:
    """Occurrences (key, start, end, value, disclosure) of the terms marked in a document (key, term, disclosure)."""
    docs = documents.select("doc_id", whole_text().alias("text")).withColumn("text_hash", F.xxhash64("text")).alias("d")
    terms = settle(marked.groupBy(*_KEY).agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("terms")), "pii-terms")
    m = terms.alias("m")
    docs = docs.join(m, same(F.col("d.doc_id"), F.col("m.doc_id")) & (F.col("d.text_hash") == F.col("m.text_hash")))
    docs = docs.select("d.doc_id", "d.text_hash", "d.text", "m.terms")
    docs = docs.withColumn("found", F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).withColumn("pieces", F.split("text", TERM, -1))
    rows = F.transform(
        "found",
        lambda v, i: F.struct(
            i.alias("at"), v.alias("value"), F.length(F.get(F.col("pieces"), i)).alias("gap"),
            F.try_element_at(F.col("terms"), F.lower(v)).alias("disclosure"),
        ),
    )
    flat = docs.select(*_KEY, F.lit("term").alias("kind"), F.inline(rows))
    once = flat.groupBy(*_KEY, "kind", "at").agg(*[F.first(c).alias(c) for c in ("value", "gap", "disclosure")])
    placed = _placed(once.repartition(shuffle_tasks(documents.sparkSession), *_KEY))
    return placed.where("disclosure IS NOT NULL").select(*_KEY, "start", "end", "value", "disclosure")


def find(documents: DataFrame, evidence: int = EVIDENCE, above: float = GENERALISE_ABOVE) -> DataFrame:
    """One row per document: doc_id, text_hash and spans, sorted by start and kind.

    A span is (start, kind number, end, value, disclosure); base spans have no disclosure.
    """
    matches = settle(base_matches(documents), "pii-matches")
    near = settle(near_terms(matches), "pii-near")
    n_terms = matches.where("kind IS NULL").agg((F.sum(F.col("n_terms") * F.col("copies")) + F.lit(1)).cast("double")).scalar()
    told = disclosing(documents, near, n_terms, evidence).where(F.col("disclosure") >= above)
    marked = near.join(settle(told, "pii-told"), ["entity", "term"]).groupBy(*_KEY, "term").agg(F.max("disclosure").alias("disclosure"))
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    base = matches.select(
        *_KEY, "copies",
        F.when(F.col("kind").isNotNull(), F.struct("start", number.alias("kind"), "end", "value", F.lit(None).cast("double").alias("disclosure"))).alias("span"),
    )
    found = term_spans(documents, marked).select(
        *_KEY, F.lit(None).cast("bigint").alias("copies"), F.struct("start", F.lit(5).alias("kind"), "end", "value", "disclosure").alias("span")
    )
    rows = base.union(found).groupBy(*_KEY).agg(F.max("copies").alias("copies"), F.sort_array(F.collect_list("span")).alias("spans"))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("_copy", "copies")


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def sanitise(documents: DataFrame, **options) -> DataFrame:
    """doc_id, text and ``clean_text``: base spans become ``[KIND]``, disclosing terms are removed or generalised.

    A removed term becomes ``[TERM]``, a generalised one its shape: a capital or small letter
    for each of its letters. Rows that repeat a document stay repeated.
    """
    found = find(documents, **options).dropDuplicates(_KEY)
    docs = documents.select("doc_id", whole_text().alias("text")).withColumn("text_hash", F.xxhash64("text")).alias("d")
    f = found.alias("f")
    rows = docs.join(f, same(F.col("d.doc_id"), F.col("f.doc_id")) & (F.col("d.text_hash") == F.col("f.text_hash")), "left")
    # Of overlapping spans the earlier one is replaced, up to the start of what is left of the later one.
    blocks = F.regexp_extract_all("d.text", F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    rows = rows.select("d.doc_id", "d.text", "f.spans", blocks.alias("blocks"), F.length("d.text").cast("bigint").alias("n"))

    def piece(a: Column, b: Column) -> Column:
        first = F.floor(a / _BLOCK).cast("int")
        held = F.array_join(F.slice(F.col("blocks"), first + 1, (F.floor(b / _BLOCK) - first + 1).cast("int")), "")
        return F.when(b > a, F.substring(held, (a % _BLOCK + 1).cast("int"), (b - a).cast("int"))).otherwise("")

    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    shape = lambda v: F.regexp_replace(F.regexp_replace(v, r"\p{Lu}", "A"), r"[\p{L}&&[^A]]", "a")

    def replaced(s: Column, i: Column) -> Column:
        until = F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(F.col("ends"), i - 1))
        label = F.when(s["disclosure"] < REMOVE_ABOVE, shape(s["value"])).otherwise(F.element_at(names, s["kind"]))
        return F.concat(piece(until, s["start"]), F.when(s["end"] > until, label).otherwise(""))

    rows = rows.withColumn("ends", F.transform("spans", lambda s: s["end"]))
    last = F.coalesce(F.array_max("ends"), F.lit(0).cast("bigint"))
    clean = F.concat(F.array_join(F.transform("spans", replaced), ""), piece(last, F.col("n")))
    return rows.select("doc_id", "text", F.when(F.size("spans") > 0, clean).otherwise(F.col("text")).alias("clean_text"))
