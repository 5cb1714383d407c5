"""Alignment of two tokenizers over the bytes of every text, and how common each pair of tokens is.

Tokens. A is a byte-level vocabulary that gets a space and the text, B a vocabulary of pieces that
adds the space itself. The bytes of the tokens of each must join to the bytes of space and text;
a text for which they do not has no tokens. Texts are tokenized once.

Links. The token ends of many texts stand one after the other, and their merge is worked off
in pieces of equal work (``mergepath``), so memory beyond the tokens is that of one piece,
for a text of any length too. A document keeps its distinct pairs of ids and how often
each is linked, as sorted numbers; that is written down and the texts are not needed again.

Counts. The number of documents that hold a pair is summed up in the tasks first, so a pair
that every document holds is one row of each task. The most common pairs (``COMMON`` of them, a
stated size whatever the input) go to all tasks, which sum up their counts by document; only
the rest travels to the table of pairs by a join on the pair, in which no pair is common.

Defined cases: a null or empty text, and one that a vocabulary does not give back byte by
byte, has no tokens: zeros and an empty ``groups_sha256``; rows that repeat an id or a text are
documents of their own in the counts; strings of special tokens inside a text are plain
text; an empty table gives no rows. Only the id and the text of the input are read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plaintide.llm import mergepath
from plaintide.session import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no install

FOLDER = "/opt/tokenizers"
A_FILE, A_RANKS, B_FILE = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Fixed value: the pattern by which the vocabulary A cuts a text.
A_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts without these are cut alike by every library, whatever its tables of letters.
_UNSURE = re.compile("[^\x00-\u024f\u2010-\u2027]|\\S{1000}|\\s{1000}")
#: A pair of ids as one number.
_B_IDS = 1 << 15
#: Pairs that are sent to every task.
COMMON = 1 << 18
#: Characters of text that are tokenized at a time, and pairs that a task counts at a time.
_CHARS, _PAIRS = 1 << 20, 1 << 22
#: What stands behind an id in the text of the groups: more of its side, the other side, the next group, nothing.
_BEHIND = (b",", b"|", b";", b"")


def _printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary.

    Bytes that are printable in Latin-1 stand for themselves, the others, in order, for the characters from 256 on.
    """
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(others)}


class Tokens:
    """Both tokenizers and the bytes of their entries."""

    def __init__(self, folder: str = FOLDER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(os.path.join(folder, A_FILE))
        self.a.encode_special_tokens = True
        with open(os.path.join(folder, A_RANKS), "rb") as file:
            ranks = {base64.b64decode(entry): int(n) for entry, n in map(bytes.split, file)}
        self.fast = tiktoken.Encoding("a", pat_str=A_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, B_FILE))
        byte = _printable_bytes()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for entry, n in self.a.get_vocab().items():
            own = [byte.get(c) for c in entry]
            self.a_bytes[n] = entry.encode() if None in own else bytes(own)
        if self.b.get_piece_size() > _B_IDS:
            raise ValueError(f"more than {_B_IDS} pieces")
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(n) else piece.replace("▁", " ").encode()
            for n, piece in enumerate(self.b.id_to_piece(list(range(self.b.get_piece_size()))))
        ]
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in own]) for own in (self.a_bytes, self.b_bytes))
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.written = [str(n).encode() + behind for n in range(most) for behind in _BEHIND]

    def _ids_of_a(self, text: str) -> list[int]:
        """By the ranks of the vocabulary where the text is surely cut as its file says, else by the file, which is slower."""
        if _UNSURE.search(text):
            return self.a.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A and of B, or nothing for texts that they do not give back."""
        of_a = [self._ids_of_a(" " + t) for t in texts]
        of_b = self.b.encode(texts, num_threads=1)
        out = []
        for text, a, b in zip(texts, of_a, of_b):
            whole = b" " + text.encode()
            same = text and b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b))
            out.append((np.array(a, np.int64), np.array(b, np.int64)) if same else None)
        return out


def align(tokens: Tokens, encoded: list[tuple[np.ndarray, np.ndarray]], piece: int = mergepath.PIECE) -> list[dict]:
    """For each document (ids of A, ids of B): number and digest of its groups, its distinct pairs and their links."""
    n_a, n_b = (np.array([len(e[side]) for e in encoded], np.int64) for side in (0, 1))
    ids_a, ids_b = (np.concatenate([e[side] for e in encoded]) for side in (0, 1))
    ends_a, ends_b = np.cumsum(tokens.a_lengths[ids_a]), np.cumsum(tokens.b_lengths[ids_b])
    document = np.repeat(np.arange(len(encoded)), n_a)  # of each token of A
    group_a, group_b = np.empty(len(ids_a), np.int64), np.empty(len(ids_b), np.int64)
    groups = np.zeros(len(encoded), np.int64)
    closed_before, held = 0, []
    for a, b, closes in mergepath.links(ends_a, ends_b, piece):
        group = closed_before + np.cumsum(closes) - closes
        group_a[a], group_b[b] = group, group
        closed_before += int(closes.sum())
        groups += np.bincount(document[a[closes]], minlength=len(encoded))
        held.append(np.unique((document[a] << 32) | (ids_a[a] * _B_IDS + ids_b[b]), return_counts=True))
    pairs, times = _summed(held)
    first = np.searchsorted(pairs, np.arange(len(encoded) + 1) << 32)
    digests = _digests(tokens, ids_a, ids_b, group_a, group_b, n_a + n_b, closed_before)
    return [
        {
            "n_a": int(n_a[k]), "n_b": int(n_b[k]), "n_groups": int(groups[k]), "n_links": int(times[first[k] : first[k + 1]].sum()),
            "groups_sha256": digests[k], "pairs": (pairs[first[k] : first[k + 1]] & 0xFFFFFFFF).astype(np.uint32),
            "times": times[first[k] : first[k + 1]],
        }
        for k in range(len(encoded))
    ]


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counted numbers of several lists as one sorted list."""
    numbers = np.concatenate([h[0] for h in held])
    unique, place = np.unique(numbers, return_inverse=True)
    return unique, np.bincount(place, np.concatenate([h[1] for h in held]), len(unique)).astype(np.int64)


def _digests(tokens: Tokens, ids_a, ids_b, group_a, group_b, sizes, groups: int) -> list[str]:
    """SHA-256 of the groups of each document, written as ``a1,a2|b1;a3|b2,b3``."""
    in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    before_a, before_b = np.cumsum(in_a), np.cumsum(in_b)
    last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    last_a[before_a - 1], last_b[before_b - 1] = 1, 2
    line = np.empty(len(ids_a) + len(ids_b), np.int64)
    line[np.arange(len(ids_a)) + (before_b - in_b)[group_a]] = ids_a * 4 + last_a
    line[np.arange(len(ids_b)) + before_a[group_b]] = ids_b * 4 + last_b
    ends = np.cumsum(sizes)
    line[ends - 1] += 1  # nothing behind the last
    out = []
    for start, end in zip(ends - sizes, ends):
        digest = hashlib.sha256()
        for at in range(start, end, 1 << 16):
            digest.update(b"".join(map(tokens.written.__getitem__, line[at : min(end, at + (1 << 16))].tolist())))
        out.append(digest.hexdigest())
    return out


_ALIGNED = "rid bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, times binary"


def _aligning(folder: str, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(folder)
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids = batch.column("doc_id")
            edges = np.cumsum([len(t or "") for t in texts]) // _CHARS
            for own in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(edges)) + 1):
                known = tokens.encode([texts[k] or "" for k in own])
                have = [k for k, e in enumerate(known) if e is not None]
                rows = [{"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": ""} for _ in own]
                if have:
                    for k, row in zip(have, align(tokens, [known[k] for k in have], piece)):
                        rows[k] = row | {"pairs": row["pairs"].tobytes(), "times": _packed(row["times"])}
                for k, row in enumerate(rows):
                    row["rid"] = rid + k
                rid += len(rows)
                frame = pd.DataFrame(rows, columns=["rid", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"], dtype=object)
                columns = {c: pa.array(frame[c], pa.binary() if c in ("pairs", "times") else pa.string() if c == "groups_sha256" else pa.int64(), from_pandas=True) for c in frame}
                columns["doc_id"] = ids.take(pa.array(own)).cast(pa.int64())
                names = [f.split()[0] for f in _ALIGNED.split(", ")]
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return run


def _packed(times: np.ndarray) -> bytes:
    """One byte each where that is enough, else four."""
    return times.astype(np.uint8 if times.max() < 256 else np.uint32).tobytes()


def _unpacked(times: bytes, n: int) -> np.ndarray:
    return np.frombuffer(times, np.uint8 if len(times) == n else np.uint32).astype(np.int64)


def aligned(documents: DataFrame, folder: str = FOLDER, piece: int = mergepath.PIECE) -> DataFrame:
    """One row per document with its tokens, groups and links, written down; ``rid`` tells the rows apart.

    ``pairs`` are the distinct linked pairs (A * 2^15 + B, 32 bits each), ``times`` how often each is linked.
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return settle(rows.mapInArrow(_aligning(folder, piece), _ALIGNED), "aligned")


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of documents to (pair, documents), counted ``_PAIRS`` at a time."""

    def counted(held: list[bytes]) -> pa.RecordBatch:
        pairs, n = np.unique(np.frombuffer(b"".join(held), np.uint32), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])

    held, size = [], 0
    for batch in batches:
        for pairs in batch.column("pairs").to_pylist():
            if pairs:
                held.append(pairs)
                size += len(pairs)
                if size >= 4 * _PAIRS:
                    yield counted(held)
                    held, size = [], 0
    if held:
        yield counted(held)


def pair_table(rows: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents the pair is linked, and whether no pair of its A id is in more.

    A window holds the pairs of one id of A, at most as many as B has ids.
    """
    counts = rows.select("pairs").mapInArrow(_counting, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    of_a = Window.partitionBy(F.shiftright("pair", 15))
    return settle(counts.withColumn("best", F.col("n") == F.max("n").over(of_a)), "pairs")


_KEPT = ["rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def _summing(common: pd.DataFrame):
    """Documents with sums over their common pairs, and their other pairs with their links."""
    known, n, best = (common[c].to_numpy() for c in ("pair", "n", "best"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"n_best": [], "count_sum": [], "rest": [], "rest_times": []}
            for pairs, times in zip(*(batch.column(c).to_pylist() for c in ("pairs", "times"))):
                pairs = np.frombuffer(pairs or b"", np.uint32).astype(np.int64)
                times = _unpacked(times or b"", len(pairs))
                place = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
                found = known[place] == pairs if len(known) else np.zeros(len(pairs), bool)
                at = place[found]
                out["n_best"].append(int(times[found][best[at]].sum()))
                out["count_sum"].append(int((times[found] * n[at]).sum()))
                out["rest"].append(pairs[~found])
                out["rest_times"].append(times[~found])
            kinds = [pa.int64()] * 2 + [pa.list_(pa.int64())] * 2
            made = [pa.array(v, k) for v, k in zip(out.values(), kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KEPT), *made], names=[*_KEPT, *out])

    return run


def scored(rows: DataFrame, common: int = COMMON) -> DataFrame:
    """The rows of ``aligned`` with n_best and count_sum over all documents."""
    table = pair_table(rows)
    most = table.orderBy(F.desc("n"), "pair").limit(common).toPandas().sort_values("pair")
    schema = ", ".join(f for f in _ALIGNED.split(", ") if f.split()[0] in _KEPT)
    schema += ", n_best bigint, count_sum bigint, rest array<bigint>, rest_times array<bigint>"
    sums = settle(rows.mapInArrow(_summing(most), schema), "common-pairs")
    rest = sums.select("rid", F.explode(F.arrays_zip("rest", "rest_times")).alias("r"))
    rest = rest.select("rid", F.col("r.rest").alias("pair"), F.col("r.rest_times").alias("times")).join(table, "pair")
    rest = rest.groupBy("rid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("times") * F.col("n")).alias("c"))
    return sums.join(rest, "rid", "left").select(
        *_KEPT[1:6],
        (F.col("n_best") + F.coalesce("b", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("c", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )


def alignment(documents: DataFrame, folder: str = FOLDER, common: int = COMMON, piece: int = mergepath.PIECE) -> DataFrame:
    """One row per document: tokens, groups, links, and how common its pairs are in the corpus."""
    return scored(aligned(documents, folder, piece), common)
