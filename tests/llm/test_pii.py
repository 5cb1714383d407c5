"""Personal data against a brute-force version."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import regex
from plaintide.llm import pii
from plaintide.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = regex.compile(r"(?<![\p{L}\p{N}@._%+-])\p{L}++(?![\p{N}@_%+-]|\.[\p{L}\p{N}])")


def holds(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    if kind == "phone":
        return 10 <= len(digits) <= 15
    return True


def base(text):
    found = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        all_ = list(re.finditer(pattern, text))
        ends = [0, *[m.end() for m in all_]]
        starts = [*[m.start() for m in all_], len(text)]
        for i, m in enumerate(all_):
            if holds(kind, m.group()):
                left, right = text[ends[i] : m.start()], text[m.end() : starts[i + 1]]
                near = TERM.findall(cut(left[::-1])[::-1].lower()), TERM.findall(cut(right).lower())
                found.append((m.start(), k, m.end(), kind, m.group(), near))
    return sorted(found)


def cut(text):
    """Up to five words at the start."""
    at, words = 0, 0
    spaces = " \t\n\x0b\x0c\r"
    while at < len(text) and text[at] in spaces:
        at += 1
    while at < len(text) and words < 5:
        words += 1
        while at < len(text) and text[at] not in spaces:
            at += 1
        while at < len(text) and text[at] in spaces:
            at += 1
    return text[:at]


def entities(kind, value):
    digits = "".join(c for c in value if c.isdigit())
    groups = {
        "email": value.lower().split("@")[-1], "ip": value.rsplit(".", 1)[0], "card": digits[:6], "phone": digits[:5],
    }
    return ("one", kind, value), ("group", kind, groups[kind])


def brute(rows):
    pairs, anywhere, around, n = defaultdict(Counter), Counter(), Counter(), 1
    for _, text in rows:
        words = TERM.findall(text.lower())
        anywhere.update(words)
        n += len(words)
        for _, _, _, kind, value, (left, right) in base(text):
            for entity in entities(kind, value):
                for term in left + right:
                    pairs[entity, term][tuple(left), tuple(right)] += 1
                    around[entity] += 1
    told = set()
    for (entity, term), contexts in pairs.items():
        together, a = sum(contexts.values()), around[entity]
        if anywhere[term] and (len(contexts) >= 3 or together >= anywhere[term]):
            if math.log2(together * n / (anywhere[term] * a)) / math.log2(max(n / a, 2)) >= 0.8:
                told.add((entity, term))
    out = []
    for key, text in rows:
        spans = base(text)
        marked = {t for s in spans for side in s[5] for t in side for e in entities(s[3], s[4]) if (e, t) in told}
        text_of = lambda spans: ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans)
        terms = [(m.start(), 4, m.end(), "term") for m in TERM.finditer(text) if m.group().lower() in marked]
        counts = Counter(s[3] for s in spans)
        out.append((key, *[counts[k] for k in PLAIN], hashlib.sha256(text_of(spans).encode()).hexdigest(), text_of(sorted([*[s[:4] for s in spans], *terms]))))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans").collect()), key=str)


def test_query_equals_brute_force(spark, sf_dir):
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{sf_dir}/documents.parquet'").fetchall()
    assert rows_of(QUERIES["op5_pii"](spark, sf_dir)) == sorted(brute(rows), key=str)


def test_edge_cases(spark, tmp_path):
    card = "4111111111111111"
    texts = [
        None, "", "a@b.c_d@e.f,x@y 1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255", f"{card} {card[:-1]}2 41-11 1111 1111 111111",
        "+1 (23) 456.7890- +12 ++1 2345678901 " + "9" * 30_000, "𝄞é q@w.de " * 3000, "a" * 200_000 + "@" + "1." * 50_000,
        "Zorp mail: z@z.de", "Zorp writes z@z.de now", "ask Zorp z@z.de please", "a@b.c_d@e.f,x@y", "a@b.c_d@e.f,x@y", "1 2 " * 20_000,
    ]
    rows = [(i if i != 4 else None, t, "kind") for i, t in enumerate(texts)] + [(2, texts[2], "kind")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    expected = brute([(i, t or "") for i, t, _ in rows])
    assert rows_of(QUERIES["op5_pii"](spark, str(tmp_path))) == sorted(expected, key=str)
    assert any("term:0:4" in e[-1] for e in expected)
    assert pii.find(docs.limit(0)).count() == 0


def test_sanitised_texts(spark):
    rows = [(i, f"{w} Zorp q@w.de {'x ' * 300}+49 170 1234567 ende") for i, w in enumerate(["Eins", "Zwei", "Drei"])] + [(9, "nothing here")]
    rows.append((10, "eins zwei drei ende and so on " * 9))  # words that stand elsewhere too tell little
    clean = {r.doc_id: r.clean_text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert clean[9] == "nothing here"
    assert clean[0].startswith("Eins [TERM] [EMAIL] x ") or clean[0].startswith("Eins Aaaa [EMAIL] ")
    assert "+49" not in clean[1] and "q@w" not in clean[1] and "[PHONE]" in clean[1]


def test_planted_names(spark):
    """Names that stand beside the addresses of one domain only are found, words that stand everywhere are not."""
    rng = np.random.default_rng(14)
    common = ["".join(rng.choice(list("abdegilmnorstu"), 5)) for _ in range(150)]
    names = [f"Name{c}{d}ius" for c in "abcdefghij" for d in "klmno"]
    rows, planted = [], 0
    for k in range(600):
        words = list(rng.choice(common, 80))
        if k % 6 == 0:
            who = names[k // 6 % 50]
            words[40:40] = [who, f"user{rng.integers(999)}@host{names.index(who)}.org"]
            planted += 1
        rows.append((k, " ".join(words)))
    found = pii.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    terms = [(r.doc_id, s.value) for r in found for s in r.spans if s.kind == 5]
    hits = sum(value in names for _, value in terms)
    assert hits == planted == 100 and len(terms) <= 1.02 * planted
    assert all(doc % 6 == 0 for doc, _ in terms)
