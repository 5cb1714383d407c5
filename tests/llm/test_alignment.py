"""Alignment against token-by-token brute force."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from plaintide.llm import alignment, mergepath
from plaintide.llm.queries import QUERIES


@pytest.fixture(scope="module")
def pair():
    a = Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.A_FILE}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.B_FILE}")


def spans(pair, text):
    """(id, first byte, end byte) of the tokens of A and of B, or nothing."""
    a, b = pair
    whole = (" " + text).encode()
    of_a, of_b = a.encode(" " + text, add_special_tokens=False), b.encode(text)
    # The bytes of A by the table the vocabulary is written in; of B by its pieces.
    table = alignment._printable_bytes()
    pieces_a = [bytes(table[c] for c in a.id_to_token(i)) if all(c in table for c in a.id_to_token(i)) else b"\xff\xff" for i in of_a.ids]
    pieces_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in of_b]
    if not text or b"".join(pieces_a) != whole or b"".join(pieces_b) != whole:
        return None
    out = []
    for ids, pieces in ((of_a.ids, pieces_a), (of_b, pieces_b)):
        at, side = 0, []
        for i, p in zip(ids, pieces):
            side.append((i, at, at + len(p)))
            at += len(p)
        out.append(side)
    return out


def brute(pair, rows):
    known, holders = [], Counter()
    for doc_id, text in rows:
        both = spans(pair, text or "")
        if both is None:
            known.append((doc_id, 0, 0, 0, [], ""))
            continue
        a, b = both
        found, j = [], 0
        for i, lo, hi in a:
            while b[j][2] <= lo:
                j += 1
            k = j
            while k < len(b) and b[k][1] < hi:
                found.append((i, b[k][0]))
                k += 1
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, lo = [], 0
        at = [0, 0]
        for end in ends:
            sides = []
            for side, tokens in enumerate((a, b)):
                own = []
                while at[side] < len(tokens) and tokens[at[side]][2] <= end:
                    own.append(str(tokens[at[side]][0]))
                    at[side] += 1
                sides.append(",".join(own))
            groups.append("|".join(sides))
        holders.update(set(found))
        known.append((doc_id, len(a), len(b), len(groups), found, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (a, _), n in holders.items():
        best[a] = max(best.get(a, 0), n)
    return [
        (d, a, b, g, len(f), sum(holders[p] == best[p[0]] for p in f), sum(holders[p] for p in f), h) for d, a, b, g, f, h in known
    ]


def test_query_equals_brute_force(spark, sf_dir, pair):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    got = [tuple(r) for r in QUERIES["op12_alignment"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(brute(pair, rows))


CASES = [
    (1, None), (2, ""), (3, "plain words of a text"), (3, "plain words of a text"), (4, " leading and  double  spaces "), (5, "tab\tand\nbreaks\r\n"),
    (6, "naïve café — “quotes” 漢字 🙂 ́"), (7, "<|endoftext|> and <s> </s> <unk> <0x41>"), (8, "▁ a real lower block"), (None, "no id"),
    (9, "ﬁ ligature and ² superscripts"), (10, "\u0000 null byte"), (11, "x" * 3000), (12, "a b " * 4000), (13, " "), (14, " "),
]


@pytest.mark.parametrize("common, piece", [(alignment.COMMON, mergepath.PIECE), (20, 7), (0, 2)])
def test_edge_cases(spark, pair, common, piece):
    """Pieces of a few steps and few common pairs give the same result."""
    docs = spark.createDataFrame([(i, t, "r", 1) for i, t in CASES], "doc_id bigint, text string, rid string, pairs int").repartition(3)
    got = [tuple(r) for r in alignment.alignment(docs, common=common, piece=piece).collect()]
    assert sorted(got, key=str) == sorted(brute(pair, CASES), key=str)
    assert alignment.alignment(docs.limit(0)).count() == 0


def test_pieces_are_equal_and_miss_nothing():
    rng = np.random.default_rng(4)
    for n in (1, 5, 800):
        end = 3 * n + 1
        a, b = (np.union1d(rng.choice(np.arange(1, end), min(n, end - 1), replace=False), [end]) for _ in range(2))
        ends = np.union1d(a, b)
        expected = list(zip(np.searchsorted(a, ends), np.searchsorted(b, ends), np.isin(ends, a) & np.isin(ends, b)))
        for piece in (1, 2, 3, 64, 10_000):
            split = mergepath.crossings(a, b, piece)
            steps = np.concatenate((np.arange(0, len(a) + len(b), piece), [len(a) + len(b)]))
            assert (np.diff(split) >= 0).all() and (np.diff(steps - split) >= 0).all() and split[-1] == len(a)
            found = [link for parts in mergepath.links(a, b, piece) for link in zip(*parts)]
            assert found == expected


def test_both_ways_to_the_ids_of_a_agree():
    tokens = alignment.Tokens()
    rng = np.random.default_rng(12)
    letters = [chr(c) for c in (*range(1, 0x250), *range(0x2010, 0x2028))] + list(" \n\t'dst 09") * 40
    words = ["don't", "we'll", "I'VE", "  ", "\r\n", "3.14", "x" * 200, "naïve", "'s", "…", " ", "\u0085", "<|endoftext|>"]
    for _ in range(400):
        parts = [rng.choice(words) if rng.random() < 0.3 else "".join(rng.choice(letters, 7)) for _ in range(20)]
        text = " " + "".join(parts)
        assert not alignment._UNSURE.search(text)
        assert tokens.fast.encode_ordinary(text) == tokens.a.encode(text, add_special_tokens=False).ids
