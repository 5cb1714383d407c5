"""URL filter over a sorted digest array.

Rules are pairs of host and path with a verdict. Their strings are hashed to 64 bits,
range-partitioned and sorted by digest on the executors; each task writes its stretch to a
file in the shared folder: digests, then offsets, then the strings and verdicts. Files are
handed to every executor by Spark and memory-mapped there, so all tasks of a machine share
one copy and only the pages that a search touches are read. The driver sees the names and
first digests of the files, one for about a million rules, and no rule.

A url is cut into host and path; for every suffix of the host at a label and every path
length that rules have, the candidate string is hashed, all candidates of a batch are
looked up at once by binary search, and a hit counts only if the stored string is equal.
The longest rule wins. Longer hosts win among rules of equal length.

Defined cases: a url that is null or has no ``://`` has an empty host and path and gets
the default verdict; a rule repeated with two verdicts blocks; a rule with a null host, path or
verdict is none; rows are kept as they are, repeated ones too, with extra columns of any name but
``judged``, which is replaced; an empty table gives no rows; an empty rule set gives the default.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import SparkFiles, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plaintide.llm.common import packed
from plaintide.llm.lines import _UPPER
from plaintide.session import settle, shared_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no install

#: (host, path, verdict): fixed values of the query. Hosts hold for all their subdomains.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
DEFAULT = "allow"
#: Rules of a file.
PART = 1 << 20


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), 42)


def pack(digests: np.ndarray, rules: list[tuple[str, str, str]]) -> bytes:
    """The file of a stretch of (host, path, verdict) rules, sorted by digest.

    The number of rules, digests, offsets, then one entry per rule: verdict, host length, host and path.
    """
    coded = [(h.encode(), p.encode(), b"B" if v == "block" else b"A") for h, p, v in rules]
    blobs = [v + len(h).to_bytes(4, "little") + h + p for h, p, v in coded]
    offsets = np.cumsum([0, *map(len, blobs)]).astype(np.int64)
    return b"".join([np.array([len(rules)], np.int64).tobytes(), digests.astype(np.uint64).tobytes(), offsets.tobytes(), *blobs])


class DigestFile:
    """A memory-mapped digest file."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n = int(raw[:8].view(np.int64)[0])
        self.digests = raw[8 : 8 + 8 * n].view(np.uint64)
        self.offsets = raw[8 + 8 * n : 16 + 16 * n].view(np.int64)
        self.blobs = raw[16 + 16 * n :]

    def entry(self, i: int) -> tuple[str, str, str]:
        blob = self.blobs[self.offsets[i] : self.offsets[i + 1]].tobytes()
        n = int.from_bytes(blob[1:5], "little")
        return blob[5 : 5 + n].decode(), blob[5 + n :].decode(), "block" if blob[:1] == b"B" else "allow"


class DigestArray:
    """All files in the order of their digests, of which each has its own stretch."""

    def __init__(self, files: list[DigestFile], firsts: list[int], labels: int, lengths: list[int]):
        self.files, self.firsts = files, np.array(firsts, np.uint64)
        self.labels, self.lengths = labels, lengths

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, str | None]]:
        """Rule and verdict of every (host, path), None where no rule fits."""
        owner, keys, found = [], [], [(0, 0, None, None)] * len(hosts)
        for i, (host, path) in enumerate(zip(hosts, paths)):
            suffix, at = host, len(host)
            for _ in range(self.labels):  # the last labels only: no rule has a longer host
                at = host.rfind(".", 0, at)
                suffix = host[at + 1 :]
                for length in self.lengths:
                    if length <= len(path):
                        owner.append(i)
                        keys.append((suffix, path[:length]))
                if at < 0:
                    break
        digests = np.fromiter((_digest(f"{h}\n{p}") for h, p in keys), np.uint64, len(keys))
        part = np.searchsorted(self.firsts, digests, "right") - 1
        for f, file in enumerate(self.files):
            own = np.flatnonzero(part == f)
            at = np.searchsorted(file.digests, digests[own])
            last = len(file.digests) - 1
            for j in np.flatnonzero(file.digests[np.minimum(at, last)] == digests[own]):
                k, i = own[j], int(at[j])
                while i <= last and file.digests[i] == digests[k]:  # collisions stand side by side
                    host, path, verdict = file.entry(i)
                    if (host, path) == keys[k]:
                        found[owner[k]] = max(found[owner[k]], (len(host) + len(path), len(host), host + path, verdict))
                    i += 1
        return [(rule, verdict) for _, _, rule, verdict in found]


def _writing(folder: str):
    """Sorted rules (digest, host, path, verdict) of a task to one file, and its name and first digest.

    A task that is run again writes a file of another name, and only that of the attempt that counts is named.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        digests = table.column("digest").to_numpy().view(np.uint64)
        system, path = fs.FileSystem.from_uri(folder)
        name = f"rules-{uuid.uuid4().hex}.bin"
        with system.open_output_stream(f"{path}/{name}") as out:
            out.write(pack(digests, list(zip(*(table.column(c).to_pylist() for c in ("host", "path", "verdict"))))))
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([int(digests[0].view(np.int64))])], names=["name", "first"])

    return run


def publish(spark: SparkSession, rules: DataFrame, part: int = PART) -> tuple[list[str], list[int], int, list[int]]:
    """Write the digest files of rules (host, path, verdict) and hand them to the executors.

    Returns their names and first digests in order, the most labels of a host and the lengths of paths.
    Every executor, also one that starts later, fetches a file once.
    """
    known = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").groupBy("host", "path")
    known = known.agg(F.when(F.max(F.col("verdict") == "block"), "block").otherwise("allow").alias("verdict"))
    known = known.withColumn("digest", F.xxhash64(F.concat_ws("\n", "host", "path")))
    known = settle(known, "rules")
    labels = F.size(F.split("host", r"\."))
    shape = known.agg(F.count("*").alias("n"), F.max(labels).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()
    if not shape.n:
        return [], [], 0, []
    system, path = fs.FileSystem.from_uri(folder := shared_folder(spark, "rule-files"))
    system.create_dir(path)
    unsigned = F.col("digest").bitwiseXOR(F.lit(-(1 << 63)))  # its order is that of the digests
    ordered = known.repartitionByRange(-(-shape.n // part), unsigned).sortWithinPartitions(unsigned)
    files = ordered.select("digest", "host", "path", "verdict").mapInArrow(_writing(folder), "name string, first bigint").collect()
    files = sorted((f.first % (1 << 64), f.name) for f in files)
    for _, name in files:
        spark.sparkContext.addFile(f"{folder}/{name}")
    return [name for _, name in files], [first for first, _ in files], shape.labels, sorted(shape.lengths)


def filtered(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, url: str = "url") -> DataFrame:
    """The pages with a struct ``judged``: host, path, rule and verdict."""
    names, firsts, labels, lengths = publish(pages.sparkSession, rules)
    opened: list[DigestArray] = []

    @F.arrow_udf("rule string, verdict string")
    def judge(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        if not opened:
            opened.append(DigestArray([DigestFile(SparkFiles.get(n)) for n in names], firsts, labels, lengths))
        answers = opened[0].judge(hosts.to_pylist(), paths.to_pylist())
        rules, verdicts = [a for a, _ in answers], [b or default for _, b in answers]
        return pa.StructArray.from_arrays([pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], ["rule", "verdict"])

    rows = packed(pages.drop("judged"))
    host, path = host_of(F.col(f"row.{url}")), path_of(F.col(f"row.{url}"))
    rows = rows.select("row", host.alias("host"), path.alias("path"), judge(host, path).alias("answer"))
    return rows.select("row.*", F.struct("host", "path", "answer.rule", "answer.verdict").alias("judged"))
