"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its subwords: byte sequences of two to four
within and across words, hashed to a fixed number of rows. A linear softmax follows.
Because averaging is linear, the trained table and the softmax fold into one score per
subword and language, and a text is scored by looking its subwords up.

Training uses a sample of labelled documents of bounded size, drawn per language by a hash
of the id; every language has its share, however many there are. The executors turn it into sparse counts, whatever the length of the texts;
the driver runs stochastic gradient descent on them in numpy. A fifth of the sample
is set aside: on it a temperature is fitted, so that scores are probabilities. All labelled
documents that were not fitted on, in the sample or not, are then scored on the executors
and counted by score: of those whose language is told right no more than a stated share
falls below the rejection threshold. Where they are too few for one of them to be that
share, the threshold lies at the least sure of them, and no higher than half way from an
even guess to certainty.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and rejected;
a null language or id is never learnt from; without any labelled document everything is
``und``; with one language every text with a letter gets it; equal texts get equal
answers; an empty table gives no rows. Only id, text and language of the input are read; ``identified``
keeps extra columns of any name but that of its result, which it replaces.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import regex
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaintide.llm.common import whole_text
from plaintide.session import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no install

BUCKETS = 1 << 13
DIMENSIONS = 16
#: Bound of the training sample: so many documents altogether, or ``LEAST`` of each language if that is more.
SAMPLE = 2000
LEAST = 4
#: Share of the documents told right that the threshold may reject, and the steps in which scores are counted for it.
REJECTED_SHARE = 0.001
STEPS = 100_000
#: Rows of the sample that are fitted on at once.
BATCH = 32
UNKNOWN = "und"
_PART = 1 << 18
_LETTER = regex.compile(r"\p{L}")
_BYTES = np.array([c if c >= 128 or chr(c).isalpha() else 0 for c in range(256)], np.uint32)


def _subwords(text: str) -> Iterator[np.ndarray]:
    """Rows of the table for the subwords of a text, part by part."""
    lowered = text.lower()
    for at in range(0, max(1, len(lowered)), _PART):
        x = _BYTES[np.frombuffer(lowered[max(0, at - 3) : at + _PART].encode("utf-8", "surrogatepass"), np.uint8)]
        x = np.concatenate(([np.uint32(0)], x, [np.uint32(0)]))
        x = x[np.concatenate(([True], (x[1:] != 0) | (x[:-1] != 0)))]
        h = x * np.uint32(2654435761)
        for n in range(1, 4):
            if len(h) < 2:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(2246822519) + x[n:] * np.uint32(2654435761)
            yield (h ^ (h >> np.uint32(13))) * np.uint32(3266489917) >> np.uint32(32 - 13)


def counts_of(text: str) -> np.ndarray:
    total = np.zeros(BUCKETS, np.int64)
    for rows in _subwords(text):
        total += np.bincount(rows, minlength=BUCKETS)
    return total


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


@dataclass(frozen=True)
class Model:
    """Per-subword scores of every language, the calibrated temperature and threshold."""

    languages: tuple[str, ...]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for rows in _subwords(text):
            total += np.bincount(rows, minlength=BUCKETS) @ self.scores
            n += len(rows)
        return _softmax((total / max(1, n) + self.bias)[None, :] / self.temperature)[0]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, its probability, and whether the text is rejected."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        p = self.probabilities(text)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.threshold)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Counts:
    """Rows of subword counts, of which only those that are not zero are held.

    Written out, a row has ``BUCKETS`` numbers, most of them zero; only the rows of a batch ever are, as shares.
    """

    used: list[np.ndarray]
    n: list[np.ndarray]

    @classmethod
    def of(cls, rows: np.ndarray) -> Counts:
        used = [np.flatnonzero(row).astype(np.uint16) for row in rows]
        return cls(used, [row[at].astype(np.float32) for row, at in zip(rows, used)])

    def __len__(self) -> int:
        return len(self.used)

    def shares(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), BUCKETS), np.float32)
        for line, i in zip(out, rows):
            line[self.used[i]] = self.n[i] / np.maximum(1, self.n[i].sum())
        return out


def _batches(rows: np.ndarray) -> list[np.ndarray]:
    return np.array_split(rows, max(1, len(rows) // BATCH))


def train(counts: Counts | np.ndarray, labels: np.ndarray, languages: tuple[str, ...], calibrate: np.ndarray, seed: int = 1, epochs: int = 12) -> Model:
    """Fit on rows of subword counts; those where ``calibrate`` holds set temperature and threshold."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    x = counts if isinstance(counts, Counts) else Counts.of(counts)
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = rng.normal(0, 0.5, (DIMENSIONS, k)).astype(np.float32)
    bias = np.zeros(k, np.float32)
    fit = np.flatnonzero(~calibrate) if (~calibrate).any() else np.arange(len(x))
    share = np.bincount(labels[fit], minlength=k) / len(fit)
    importance = (1 / np.maximum(share, 1e-3) / k).astype(np.float32)
    seen = [np.full_like(p, 1e-8) for p in (table, weights, bias)]
    for _ in range(epochs):
        for part in _batches(rng.permutation(fit)):
            xs = x.shares(part)
            mean = xs @ table
            slope = _softmax(mean @ weights + bias)
            slope[np.arange(len(part)), labels[part]] -= 1
            slope *= importance[labels[part], None] / len(part)
            steps = (xs.T @ (slope @ weights.T), mean.T @ slope, slope.sum(axis=0))
            for p, g, s in zip((table, weights, bias), steps, seen):
                s += g * g
                p -= 0.15 * g / np.sqrt(s)
    scores = (table @ weights).astype(np.float64)
    held = np.flatnonzero(calibrate) if calibrate.any() else fit
    logits = np.concatenate([x.shares(part) @ scores.astype(np.float32) for part in _batches(held)]).astype(np.float64) + bias
    truth = labels[held]

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(1e-12, _softmax(logits / t)[np.arange(len(held)), truth])).mean())

    temperature = min(np.geomspace(0.05, 20, 60), key=loss)
    p = _softmax(logits / temperature)
    steps, n = np.unique(np.floor(p.max(axis=1)[p.argmax(axis=1) == truth] * STEPS), return_counts=True)
    return Model(languages, scores, bias.astype(np.float64), float(temperature), threshold_of(steps, n, k))


def threshold_of(steps: np.ndarray, n: np.ndarray, languages: int) -> float:
    """The highest step below which no more than the share of the scores lies: ``n`` scores in each of the sorted steps."""
    if not len(steps):
        return 0.0
    allowed = int(REJECTED_SHARE * n.sum())
    at = float(steps[np.flatnonzero(np.cumsum(n) - n <= allowed)[-1]] / STEPS)
    return at if allowed else min(at, (1 + 1 / languages) / 2)


def held_out() -> Column:
    """Documents that nothing is learnt from: a fifth, by a checksum of the id. Null ids are not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(documents: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on at most about ``sample`` labelled documents, or ``LEAST`` of each language, evenly from each language."""
    labelled = documents.where(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")
    languages = {r.lang: r.n for r in sizes.collect()}  # one row per language, as the model has
    if not languages:
        return Model((), np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30))
    share = F.create_map(*[F.lit(v) for lang, n in languages.items() for v in (lang, min(1 << 30, round((1 << 30) * max(sample / len(languages), LEAST) / n)))])
    drawn = labelled.select("lang", draw.alias("draw"), whole_text().alias("text"), (draw < F.element_at(share, F.col("lang"))).alias("chosen"))
    chosen = drawn.where("chosen")

    def sparse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, lang, draw_ in zip(frame["text"], frame["lang"], frame["draw"]):
                if not has_letter(text):
                    continue
                words = text.split()
                at = draw_ % max(1, len(words) - 12)
                for piece, short in ((text, False), (" ".join(words[at : at + 12]), True)):
                    c = counts_of(piece)
                    used = np.flatnonzero(c)
                    rows.append((lang, draw_, short, used.astype(np.uint16).tobytes(), c[used].astype(np.float32).tobytes()))
            yield pd.DataFrame(rows, columns=["lang", "draw", "short", "used", "n"])

    rows = settle(chosen.mapInPandas(sparse, "lang string, draw bigint, short boolean, used binary, n binary"), "language-sample")
    frame = rows.orderBy("draw", "lang", "short", "used").toPandas()
    if frame.empty:
        return Model((), np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    names = tuple(sorted(set(frame["lang"])))
    counts = Counts([np.frombuffer(v, np.uint16) for v in frame["used"]], [np.frombuffer(v, np.float32) for v in frame["n"]])
    labels = np.array([names.index(v) for v in frame["lang"]])
    model = train(counts, labels, names, (frame["draw"].to_numpy() // 7 % 5 == 0))
    return calibrated(model, drawn.where("NOT chosen OR chosen IS NULL OR draw DIV 7 % 5 = 0"))


def calibrated(model: Model, unseen: DataFrame) -> Model:
    """The model with its threshold from labelled documents (lang, text) that it was not fitted on, if there are any."""
    scored = identified(unseen, model, "_l").where("_l.lang_pred = lang")
    steps = scored.groupBy(F.floor(F.col("_l.score") * STEPS).alias("step")).agg(F.count("*").alias("n"))
    rows = steps.orderBy("step").toPandas()  # at most STEPS + 1 rows
    if rows.empty:
        return model
    return replace(model, threshold=threshold_of(rows["step"].to_numpy(), rows["n"].to_numpy(), len(model.languages)))


def identified(documents: DataFrame, model: Model, column: str = "language") -> DataFrame:
    """The documents with a struct of lang_pred, score and rejected."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return documents.withColumn(column, predict(F.col("text")))
