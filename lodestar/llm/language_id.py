"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit a logistic classifier over hashed byte
n-grams (1 to 3, of letters only) is trained here, on about PER_LANGUAGE texts of each language and
TRAINED of all at most, drawn by a hash of the id. A text's languages are ranked by the loss of its bits against each codeword,
each bit weighted by how well it does in training; score is the softmax share of the
nearest one, and a text is ambiguous where the second comes close.

Defined results: und with score 0 for a null text or one without a letter; a null id is not
used for training; texts are read whole; a table without labelled rows gives und with
score 0 for all; ties go to the smaller language name. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, tidy, trim
from .words import bytes_of, slices

BUCKETS = 4096
PER_LANGUAGE = 1000
#: Bound of the training texts of all languages together; with many languages each has fewer.
TRAINED = 8000
#: Texts whose features are held at once: BUCKETS doubles each.
ROWS = 256
STEPS = 120
AMBIGUOUS = 0.1

#: ASCII letters in lower case, bytes above ASCII as they are, all else one separator.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed n-grams, a row for each text."""
    n, f = len(offs) - 1, _FOLD[buf].astype(np.uint32)
    text = np.repeat(np.arange(n, dtype=np.int64), np.diff(offs))
    counts = np.zeros(n * BUCKETS)
    code = f
    for k in (1, 2, 3):
        if k > 1:
            code = code[:-1] * np.uint32(257) + f[k - 1 :]
        if not len(code):
            break
        inside = (text[: len(code)] == text[k - 1 :]) & (f[: len(code)] != 32) if k == 1 else text[: len(code)] == text[k - 1 :]
        bucket = ((code * np.uint32(2654435761) + np.uint32(k * 40503)) >> np.uint32(20)).astype(np.int64)
        counts += np.bincount((text[: len(code)] * BUCKETS + bucket)[inside], minlength=n * BUCKETS)
    counts = counts.reshape(n, BUCKETS)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))


def codewords(k: int) -> np.ndarray:
    """A row of +1 and -1 for each of k languages: exhaustive for few, else the most distant of seeded draws."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 5:
        bits = [[1 if (c >> i) & 1 else -1 for i in range(k)] for c in range(1, 1 << k) if not c & 1 and c != 0]
        return np.array(bits, float).T
    rng, length, best = np.random.default_rng(7), int(15 + 10 * np.ceil(np.log2(k))), (-1, None)
    for _ in range(50):
        m = rng.choice([-1.0, 1.0], (k, length))
        apart = (length - m @ m.T) / 2 + np.eye(k) * length
        if np.abs(m.sum(0)).max() < k and apart.min() > best[0]:
            best = (apart.min(), m)
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # (buckets + 1) x bits
    trust: np.ndarray  # bits

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Shares of the languages, a row for each row of features."""
        margin = x @ self.weights[:-1] + self.weights[-1]
        loss = np.stack([(np.logaddexp(0, -margin * c) * self.trust).sum(1) for c in self.code], 1)
        e = np.exp(loss.min(1, keepdims=True) - loss)
        return e / e.sum(1, keepdims=True)


def fit(x: np.ndarray, languages: list[str]) -> Model:
    names = sorted(set(languages))
    code = codewords(len(names))
    y = code[[names.index(v) for v in languages]]
    share = np.array([languages.count(v) for v in names], float)
    row = (1 / share)[[names.index(v) for v in languages]][:, None] / len(names)
    w = np.zeros((BUCKETS + 1, code.shape[1]))
    m, v = np.zeros_like(w), np.zeros_like(w)
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    del x
    for t in range(1, STEPS + 1):
        margin = np.clip(y * (x1 @ w.astype(x1.dtype)), -80, 80)
        g = -x1.T @ (row * y / (1 + np.exp(margin))).astype(x1.dtype) + 1e-6 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-12)
    right = (row * ((x1 @ w.astype(x1.dtype)) * y > 0)).sum(0)
    trust = np.log(np.clip(right, 0.5001, 0.999) / (1 - np.clip(right, 0.5001, 0.999)))
    return Model(names, code, w, trust / trust.sum() * code.shape[1])


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    labelled = docs.filter((remainder(F.col("doc_id")) != 1) & F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).alias("_h"))
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    languages = counts.count()
    if not languages:
        return None
    each = max(1, min(per_language, TRAINED // languages))
    drawn = small(counts.select(F.col("lang").alias("_lang"), (F.lit(1 << 20) * F.least(F.lit(1.0), F.lit(each) / F.col("n"))).alias("_below")))
    sample = labelled.join(drawn, F.col("lang") == F.col("_lang")).filter("_h < _below").select("lang", "text")

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = bytes_of(b.column("text"))
            for i, j, part, o in slices(buf, offs, rows=ROWS):
                x = features(part, o).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column("lang").slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    # about TRAINED rows of 2 * BUCKETS bytes
    got = sample.mapInArrow(tidy(featurize), "lang string, x binary").collect()
    got = sorted((r["lang"], bytes(r["x"])) for r in got)
    languages, x = [lang for lang, _ in got], np.frombuffer(b"".join(v for _, v in got), np.float16).reshape(len(got), BUCKETS).astype(np.float32)
    del got
    model = fit(x, languages)
    del x
    trim()
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs' doc_id with held_out, lang_pred, score, ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            buf, offs = bytes_of(b.column("text"))
            names, score, unsure = [], [], []
            for i, j, part, o in slices(buf, offs, rows=ROWS):
                s = model.scores(features(part, o)) if model else np.zeros((j - i, 1))
                letters = np.add.reduceat(np.append((part >= 97) & (part < 123) | (part >= 65) & (part < 91), False).astype(np.int64), o[:-1]) * (np.diff(o) > 0)
                for r in range(j - i):
                    if not letters[r] and not any(c.isalpha() for c in part[o[r] : o[r + 1]].tobytes().decode("utf-8", "replace")) or model is None:
                        names.append("und"), score.append(0.0), unsure.append(True)
                        continue
                    best = int(s[r].argmax())
                    second = np.partition(s[r], -2)[-2] if s.shape[1] > 1 else 0.0
                    names.append(model.languages[best]), score.append(float(s[r, best])), unsure.append(bool(s[r, best] - second < AMBIGUOUS))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select("doc_id", "text", F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))
