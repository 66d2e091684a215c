"""Toxicity by cumulative-link ordinal regression.

Grades: 0 clean, 1 mild, 2 severe. Labels only say toxic or not, so a labelled toxic text is severe
where the share of its features that go with toxic labels is above the toxic texts' median; which
features do is read from the other half of the training texts, never from the text itself. Features are
hashed words and word beginnings (4 to 6 bytes), present or absent; those seen in enough
training texts, and most associated with the labels, are kept. One weight vector serves both ordered
thresholds: P(grade >= k) = sigmoid(w.x - t_k); expected severity is the sum of these.

Training draws about TOXIC and CLEAN labelled texts at most, by a hash of the id (a documented bound), and
runs in one task, so that the driver gets no more than the kept features and their weights.

Defined results: a null or empty text has no features; labels without id or grade are
left out, of several for one id the most toxic counts, and of several texts for one id the least; without both kinds of labels the
severity is 0 for all; rows that repeat are scored alike; texts are read whole. Other
columns are ignored by score() and kept by clean().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .words import LOWER, bytes_of, hash_words, slices, split_words

TOXIC, CLEAN = 3000, 6000
BITS = 20
KEPT = 4096
SEEN = 4
STEPS = 200
#: Probability from which a text counts as toxic, the best of held-out labels (0.5 misses more, 0.3 takes clean ones along).
THRESHOLD = 0.4

_APART = np.ones(256, bool)
_APART[48:58] = _APART[65:91] = _APART[97:123] = _APART[128:] = False


def text_features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) for each word and word beginning, with repeats."""
    buf = LOWER[buf]
    begins, ends, first = split_words(buf, offs, _APART)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    found = [hash_words(buf, begins, ends) ^ np.uint64(1)]
    found += [hash_words(buf, begins, np.minimum(ends, begins + k)) + np.uint64(k) for k in (4, 5, 6)]
    return np.tile(text, 4), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def distinct(text: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code = np.unique((text.astype(np.int64) << BITS) | feature)
    return code >> BITS, code & ((1 << BITS) - 1)


@dataclass
class Model:
    index: np.ndarray  # feature -> place among the kept, or -1
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, text: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2) for each of n texts."""
        known = self.index[feature] >= 0
        t, f = distinct(text[known], feature[known])
        eta = np.bincount(t, self.weights[self.index[f]], minlength=n)[:n]
        return _sigmoid(eta[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def grades(rows: np.ndarray, feats: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """0, 1 or 2 for each text. Halves of the texts tell each other which features go with toxic labels."""
    share = np.zeros(len(toxic))
    for half in (0, 1):
        told = rows % 2 != half
        place = np.cumsum(np.arange(len(toxic)) % 2 != half) - 1
        kept, bad = associated(place[rows[told]], feats[told], toxic[np.arange(len(toxic)) % 2 != half])
        goes = np.zeros(1 << BITS, bool)
        goes[kept] = bad
        mine = ~told
        share += np.bincount(rows[mine], goes[feats[mine]], minlength=len(toxic)) / np.maximum(np.bincount(rows[mine], minlength=len(toxic)), 1)
    return np.where(toxic == 1, np.where(share > np.median(share[toxic == 1]), 2, 1), 0)


def associated(rows: np.ndarray, feats: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept features and whether each goes with toxic labels, by chi-square."""
    n, n1 = max(1, len(toxic)), int(toxic.sum())
    a = np.bincount(feats, toxic[rows], minlength=1 << BITS)
    seen = np.bincount(feats, minlength=1 << BITS).astype(float)
    expected = seen * n1 / n
    chi = np.where(seen >= SEEN, (a - expected) ** 2 / np.maximum(expected * (1 - seen / n) * (1 - n1 / n), 1e-9), 0)
    kept = np.argsort(-chi, kind="stable")[:KEPT]
    kept = np.sort(kept[chi[kept] > 0])
    return kept, (a - expected)[kept] > 3 * np.sqrt(np.maximum(expected[kept], 1))


def fit(rows: np.ndarray, feats: np.ndarray, toxic: np.ndarray) -> Model:
    """rows, feats: distinct (text, feature) pairs; toxic: 0 or 1 for each text."""
    often = (np.bincount(feats, minlength=1 << BITS) >= SEEN)[feats]
    rows, feats = rows[often], feats[often]
    kept, _ = associated(rows, feats, toxic)
    index = np.full(1 << BITS, -1, np.int32)
    index[kept] = np.arange(len(kept))
    at = index[feats] >= 0
    r, c, n = rows[at], index[feats[at]], len(toxic)
    grade = grades(rows, feats, toxic)
    w, theta = np.zeros(len(kept)), np.array([1.0, 0.0])  # thresholds t1, t1 + exp
    m = [np.zeros_like(w), np.zeros(2)]
    v = [np.zeros_like(w), np.zeros(2)]
    for t in range(1, STEPS + 1):
        cut = np.array([theta[0], theta[0] + np.exp(theta[1])])
        p = _sigmoid(np.bincount(r, w[c], minlength=n)[:, None] - cut)
        slope = p * (1 - p)
        is0, is1, is2 = grade == 0, grade == 1, grade == 2
        like = np.where(is0, 1 - p[:, 0], np.where(is1, p[:, 0] - p[:, 1], p[:, 1])) + 1e-12
        d1 = (np.where(is0, -1, np.where(is1, 1, 0)) * slope[:, 0]) / like  # of the log-likelihood by eta - t1
        d2 = (np.where(is2, 1, np.where(is1, -1, 0)) * slope[:, 1]) / like
        g = [-np.bincount(c, (d1 + d2)[r], minlength=len(w)) / n + 1e-4 * w, np.array([(d1 + d2).sum(), d2.sum() * np.exp(theta[1])]) / n]
        for i, x in enumerate((w, theta)):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g[i], 0.999 * v[i] + 0.001 * g[i] ** 2
            x -= 0.05 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-9)
    return Model(index, w, np.array([theta[0], theta[0] + np.exp(theta[1])]))


def train(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> Model | None:
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    known = known.filter("_toxic in (0, 1)").withColumn("_h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)))
    counts = {r["_toxic"]: r["n"] for r in known.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    share = {0: min(1.0, clean / counts[0]), 1: min(1.0, toxic / counts[1])}
    drawn = known.filter(F.col("_h") < F.when(F.col("_toxic") == 1, share[1]).otherwise(share[0]) * (1 << 24)).select(F.col("doc_id").alias("_id"), "_toxic")
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).groupBy("_id", "_toxic").agg(F.min("text").alias("text"))  # about toxic + clean rows

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = bytes_of(b.column("text"))
            for i, j, part, o in slices(buf, offs):
                t, f = distinct(*text_features(part, o))
                cut = np.searchsorted(t, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([b.column("_toxic").slice(i, j - i).cast(pa.int32()), pa.array([f[cut[k] : cut[k + 1]].astype(np.int32).tobytes() for k in range(j - i)], pa.binary())], ["toxic", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(x for b in batches for x in zip(b.column("toxic").to_pylist(), b.column("x").to_pylist()))
        y = np.array([t for t, _ in got])
        if len(set(y.tolist())) < 2:
            return
        rows = np.repeat(np.arange(len(got), dtype=np.int32), [len(x) // 4 for _, x in got])
        feats = np.frombuffer(b"".join(x for _, x in got), np.int32)
        del got
        model = fit(rows, feats, y)
        parts = (np.flatnonzero(model.index >= 0).astype(np.int32), model.weights, model.thresholds)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["kept", "weights", "thresholds"])

    rows = sample.select("_toxic", "text").mapInArrow(tidy(featurize), "toxic int, x binary").repartition(1)  # about toxic + clean rows
    got = rows.mapInArrow(tidy(learn), "kept binary, weights binary, thresholds binary").first()
    if got is None:
        return None
    index = np.full(1 << BITS, -1, np.int32)
    kept = np.frombuffer(got["kept"], np.int32)
    index[kept] = np.arange(len(kept))
    return Model(index, np.frombuffer(got["weights"]), np.frombuffer(got["thresholds"]))


#: Columns that scoring adds.
SCORES = "p_mild double, p_severe double, severity double, toxic boolean"


def _scored(docs: DataFrame, model: Model | None, columns: list[str], threshold: float) -> DataFrame:
    """The columns asked for, with SCORES; rows in any number and order."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            buf, offs = bytes_of(b.column("_text"))
            p = [np.zeros((0, 2))]
            for i, j, part, o in slices(buf, offs):
                p.append(model.at_least(*text_features(part, o), j - i) if model else np.zeros((j - i, 2)))
            p = np.concatenate(p)
            own = [b.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*own, pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p.sum(1)), pa.array(p[:, 0] >= threshold)], [*columns, "p_mild", "p_severe", "severity", "toxic"])

    out = docs.select(*columns, F.col("text").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema.fields)
    return out.mapInArrow(tidy(run), f"{kinds}, {SCORES}")


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id with p_mild, p_severe, severity (0 to 2) and toxic (p_mild at least threshold)."""
    return _scored(docs, train(docs, labels), ["doc_id"], threshold)


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are not toxic, with their columns."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            buf, offs = bytes_of(b.column(names.index("text")))
            for i, j, part, o in slices(buf, offs):
                keep = model.at_least(*text_features(part, o), j - i)[:, 0] < threshold if model else np.ones(j - i, bool)
                yield b.slice(i, j - i).filter(pa.array(keep))

    return docs.mapInArrow(tidy(run), docs.schema)
