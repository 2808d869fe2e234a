"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The logit of a document is w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j with low-rank vectors v. The pair sum
is never expanded: it is half of (sum v_i x_i)^2 - sum (v_i x_i)^2 per factor, linear in the features present.

Words are hashed to ``SLOTS`` with log counts scaled to unit length; statistics of the text's structure and the stated
n_chars are standardised. The machine is fitted with AdaGrad on the driver from a sample of labelled rows that is
bounded by ``SAMPLE``; per row it holds at most one entry per slot. Scoring runs where the rows are.

Edge cases: null texts are empty and are scored by their statistics; null n_chars counts as 0; labels that are
null are not learned from, conflicting labels of a doc_id are averaged, labels of unknown documents are ignored; with
no labelled row or one class the score is the smoothed share of label 1; repeated rows are each scored; other columns
are ignored by the report and kept by ``accepted``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldmark.llm.common import crc_part

SLOTS = 1 << 14
SAMPLE = 4_000  # labelled rows that the fit may use
FACTORS = 8
EPOCHS = 12
BATCH = 128
RATE = 0.05
DECAY = 1e-4
HELD_OUT_PARTS = 5
LEAST_SCORE = 0.3

_CLASS = np.zeros(256, np.int64)  # classes of bytes: 1 upper, 2 lower, 3 digit, 4 sentence mark, 5 other mark, 6 blank, 7 beyond ASCII
_CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("a") : ord("z") + 1], _CLASS[ord("0") : ord("9") + 1] = 1, 2, 3
_CLASS[33:48] = _CLASS[58:65] = _CLASS[91:97] = _CLASS[123:127] = 5
_CLASS[list(b".,;:?'")] = 4
_CLASS[[9, 10, 11, 12, 13, 32]] = 6
_CLASS[128:] = 7
STATISTICS = 18


def is_mark(token: bytes) -> bool:
    """Whether a word is a single byte that is no letter and no digit."""
    return len(token) == 1 and not token.isalnum()


def features(text: str | None, n_chars: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots, their values and the statistics of one document."""
    raw = (text or "").encode()
    tokens = raw.split()
    counts = Counter(tokens)
    n, chars = len(tokens), len(raw)
    seen = np.fromiter(map(crc32, counts), np.int64, len(counts)) % SLOTS
    slots, back = np.unique(seen, return_inverse=True)
    values = np.log1p(np.bincount(back, np.fromiter(counts.values(), np.float64, len(counts)), len(slots)))
    values /= max(1e-9, math.sqrt(values @ values)) if len(values) else 1
    kinds = np.bincount(_CLASS, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), 8) / max(chars, 1)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    again = sum(map(eq, tokens, tokens[1:]))
    marked = sum(t[-1] in b"#$%&*!|" for t in tokens)
    stated = float(n_chars) if n_chars is not None and n_chars == n_chars else 0.0
    plain = [
        math.log1p(chars), math.log1p(n), math.log1p(len(lines)), sum(map(len, tokens)) / max(n, 1), len(counts) / max(n, 1),
        again / max(n, 1), marked / max(n, 1), max(counts.values(), default=0) / max(n, 1),
        (len(lines) - len(set(lines))) / max(len(lines), 1), math.log1p(max(0.0, stated)), sum(map(is_mark, tokens)) / max(n, 1), *kinds[1:],
    ]
    return slots.astype(np.uint16), values.astype(np.float32), np.array(plain, np.float32)


@dataclass
class Machine:
    """A fitted factorisation machine; the last ``STATISTICS`` weights belong to the standardised statistics."""

    mean: np.ndarray
    scale: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    constant: float | None = None

    def rows(self, each: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices, values and the row starts of the sparse rows."""
        extra = np.arange(SLOTS, SLOTS + STATISTICS)
        index = [np.concatenate((s.astype(np.int64), extra)) for s, _, _ in each]
        value = [np.concatenate((v, np.clip((p - self.mean) / self.scale, -5, 5) / 2)) for _, v, p in each]
        starts = np.cumsum([0] + [len(i) for i in index[:-1]])
        return np.concatenate(index), np.concatenate(value).astype(np.float32), starts

    def logits(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits with the terms that a gradient needs again: v_i x_i and its sums per row."""
        parts = self.factors[index] * value[:, None]
        sums = np.add.reduceat(parts, starts)
        pairs = 0.5 * (sums * sums - np.add.reduceat(parts * parts, starts)).sum(axis=1)
        return self.bias + np.add.reduceat(self.linear[index] * value, starts) + pairs, parts, sums

    def scores(self, each: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(each), self.constant)
        out = [np.zeros(0)]
        for at in range(0, len(each), 256):
            logit = self.logits(*self.rows(each[at : at + 256]))[0].astype(np.float64)
            out.append(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
        return np.concatenate(out)


def fit(each: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 11) -> Machine:
    """AdaGrad on the log loss, in an order that depends on the seed only."""
    good = int(labels.sum())
    draw = np.random.default_rng(seed)
    size = SLOTS + STATISTICS
    dense = np.array([p for _, _, p in each], np.float64).reshape(-1, STATISTICS)
    machine = Machine(np.zeros(STATISTICS), np.ones(STATISTICS), 0.0, np.zeros(size, np.float32), np.zeros((size, FACTORS), np.float32))
    if good in (0, len(labels)):
        machine.constant = (good + 0.5) / (len(labels) + 1)
        return machine
    machine.mean, machine.scale = dense.mean(axis=0), np.maximum(dense.std(axis=0), 1e-3)
    machine.bias = math.log((good + 0.5) / (len(labels) - good + 0.5))
    machine.factors = draw.normal(0, 0.05, (size, FACTORS)).astype(np.float32)
    bias_seen, linear_seen, factor_seen = 1e-6, np.full(size, 1e-6, np.float32), np.full((size, FACTORS), 1e-6, np.float32)
    steps = max(EPOCHS, -(-600 * BATCH // len(labels)))  # few rows are passed over more often
    for _ in range(min(steps, 200)):
        order = draw.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            index, value, starts = machine.rows([each[i] for i in chosen])
            logit, parts, sums = machine.logits(index, value, starts)
            error = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[chosen]) / len(chosen)).astype(np.float32)
            row = np.repeat(np.arange(len(chosen)), np.diff(np.append(starts, len(index))))
            touched, back = np.unique(index, return_inverse=True)
            slope = error[row] * value
            linear = np.bincount(back, slope, len(touched)).astype(np.float32) + DECAY * machine.linear[touched]
            whole = slope[:, None] * (sums[row] - parts)
            factor = np.zeros((len(touched), FACTORS), np.float32)
            for k in range(FACTORS):
                factor[:, k] = np.bincount(back, whole[:, k], len(touched))
            factor += DECAY * machine.factors[touched]
            linear_seen[touched] += linear * linear
            factor_seen[touched] += factor * factor
            machine.linear[touched] -= RATE * linear / np.sqrt(linear_seen[touched])
            machine.factors[touched] -= 0.2 * RATE * factor / np.sqrt(factor_seen[touched])
            bias_seen += float(error.sum()) ** 2
            machine.bias -= RATE * float(error.sum()) / math.sqrt(bias_seen)
    return machine


def held_out(doc_id: Column, parts: int = HELD_OUT_PARTS) -> Column:
    return crc_part(doc_id, parts) == 0


def _with_n_chars(docs: DataFrame) -> Column:
    return F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")


def _featured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for label, doc_id, text, stated in zip(frame["_label"], frame["_id"], frame["text"], frame["n_chars"]):
            slots, values, plain = features(text, stated)
            rows.append((doc_id, label, slots.tobytes(), values.tobytes(), plain.tobytes()))
        yield pd.DataFrame(rows, columns=["doc_id", "label", "slots", "values", "plain"])


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """The machine from at most ``sample`` labelled documents that are not held out, by digest of their id; labels of others are left out first."""
    known = labels.filter("quality is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("_label"))
    known = known.join(docs.select(F.col("doc_id").alias("_own")), F.col("_id") == F.col("_own"), "left_semi")
    known = F.broadcast(known.orderBy(F.xxhash64("_id"), "_id").limit(sample))
    texts = docs.select(F.col("doc_id").alias("_doc"), "text", _with_n_chars(docs).alias("n_chars"))
    rows = texts.join(known, F.col("_doc") == F.col("_id")).groupBy("_id", "_label").agg(F.min(F.struct("text", "n_chars")).alias("d"))
    rows = rows.select("_id", "_label", "d.text", "d.n_chars")
    found = rows.mapInPandas(_featured, "doc_id long, label double, slots binary, values binary, plain binary").collect()
    found.sort(key=lambda r: r["doc_id"])
    each = [(np.frombuffer(r["slots"], np.uint16), np.frombuffer(r["values"], np.float32), np.frombuffer(r["plain"], np.float32)) for r in found]
    return fit(each, np.array([r["label"] for r in found]))


def score_column(docs: DataFrame, machine: Machine) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(vars(machine))

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series, stated: pd.Series) -> pd.Series:
        machine = Machine(**shared.value)
        return pd.Series(machine.scores([features(t, n) for t, n in zip(texts, stated)]))

    return score("text", _with_n_chars(docs))


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted per row of ``docs``."""
    score = score_column(docs, learned(docs, labels, sample))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= LEAST_SCORE).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    return docs.withColumn("_score", score_column(docs, learned(docs, labels, sample))).filter(F.col("_score") >= LEAST_SCORE).drop("_score")
