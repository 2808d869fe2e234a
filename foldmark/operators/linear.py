"""Linear fits from sums: out-of-fold ridge from one aggregate, and logistic fits of many labels in shared scans.

Only sums reach the driver, whose size depends on the numbers of features, folds and labels and never on the rows.
Rows with a null among features or target are left out of a fit; their prediction is null.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_FEATURES = 100  # of a fit; its sums grow with the square
MOST_CELLS = 4_000_000  # numbers that reach the driver per pass


def _whole(cols: Sequence[str]) -> Column:
    found = F.lit(True)
    for c in cols:
        found &= F.col(c).isNotNull()
    return found


def fold_moments(df: DataFrame, columns: Sequence[str], fold: str) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Per fold the number of whole rows, the means, and the sums of products of deviations: one aggregate for all folds."""
    names = [f"_m{i}" for i in range(len(columns))]
    rows = df.filter(_whole([*columns, fold])).select(F.col(fold).cast("int").alias("_f"), *[F.col(c).cast("double").alias(n) for c, n in zip(columns, names)])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1)]
    sums = rows.groupBy("_f").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(n) for n in names]).alias("means"), F.array(*[F.covar_pop(names[i], names[j]) for i, j in pairs]).alias("spread")
    )
    out = {}
    for r in sums.collect():  # a row per fold
        spread = np.zeros((len(columns), len(columns)))
        for (i, j), v in zip(pairs, r["spread"]):
            spread[i, j] = spread[j, i] = v * r["n"]
        out[r["_f"]] = r["n"], np.array(r["means"]), spread
    return out


def merged(parts: Sequence[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Moments of several folds together; deviations add up about the common mean, so nothing cancels."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    spread = sum(p[2] + p[0] * np.outer(p[1] - mean, p[1] - mean) for p in parts)
    return n, mean, spread


def solved(moments: tuple[int, np.ndarray, np.ndarray], strength: float) -> tuple[float, np.ndarray]:
    """Intercept and coefficients from moments whose last column is the target.

    The penalty counts in standard deviations of features and target, as in ``models.linear``. Features without spread, or without any of their own, count nothing.
    """
    n, mean, spread = moments
    c, y = spread[:-1, :-1] / n, spread[:-1, -1] / n
    deviation = np.sqrt(spread[-1, -1] / n)
    scale = np.sqrt(np.diag(c))
    scale = np.where(scale > 0, scale, 1.0)
    standard = c / np.outer(scale, scale) + np.diag(np.full(len(y), strength / deviation if deviation > 0 else 0.0))
    weights = np.linalg.lstsq(standard, y / scale, rcond=1e-12)[0] / scale
    return float(mean[-1] - weights @ mean[:-1]), weights


def ridge_out_of_fold(
    df: DataFrame, features: Sequence[str], target: str, key: Sequence[str], fold: str, strength: float = 0.0, keep: Sequence[str] = ()
) -> DataFrame:
    """``key`` + ``fold`` + ``keep`` + ``prediction`` of the least squares fit that did not see the row's fold.

    One scan gives the moments of every fold; the fit without a fold is solved from those of all the others, and predictions are an
    expression on the rows, so they need no refit, no join and no second model pass. A fold without others has no prediction.
    """
    if len(features) > MOST_FEATURES:
        raise ValueError(f"more than {MOST_FEATURES} features")
    parts = fold_moments(df, [*features, target], fold)
    lines = {}
    for f in parts:
        others = [p for g, p in parts.items() if g != f]
        if others:
            intercept, weights = solved(merged(others), strength)
            lines[f] = [intercept, *weights.tolist()]
    if not lines:
        found = F.lit(None).cast("double")
    else:
        fits = F.create_map(*[x for f, line in lines.items() for x in (F.lit(f), F.array(*[F.lit(float(v)) for v in line]))])
        line = F.try_element_at(fits, F.col(fold).cast("int"))
        found = line[0]
        for i, c in enumerate(features, 1):
            found = found + line[i] * F.col(c).cast("double")
    return df.select(*key, fold, *keep, found.alias("prediction"))


def _passed(shared, size: int):
    """Loss, gradient and curvature of every label over a task's rows, as (label, place, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beta, positive, negative, known = shared.value
        total = np.zeros((len(known), 1 + size + size * size))
        number = {label: i for i, label in enumerate(known)}
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), *[batch.column(i).to_numpy(zero_copy_only=False) for i in range(size - 1)]])
            y = np.zeros((batch.num_rows, len(known)))
            for r, labels in enumerate(batch.column(size - 1).to_pylist()):
                for label in labels or ():
                    if label in number:
                        y[r, number[label]] = 1.0
            margin = x @ beta
            p = 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))
            w = np.where(y > 0, positive, negative)
            total[:, 0] += (w * (np.logaddexp(0.0, margin) - y * margin)).sum(axis=0)
            total[:, 1 : 1 + size] += (x.T @ (w * (p - y))).T
            bend = w * p * (1.0 - p)
            for i in range(len(known)):
                total[i, 1 + size :] += ((x * bend[:, i : i + 1]).T @ x).ravel()
        label, place = np.indices(total.shape).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(label.ravel()), pa.array(place.ravel()), pa.array(total.ravel())], ["label", "place", "v"])

    return run


def fit_labels(
    df: DataFrame, features: Sequence[str], labels: str, vocabulary: Sequence, penalty: float = 1e-4, passes: int = 40, close: float = 1e-9
) -> tuple[dict[object, np.ndarray], int]:
    """Balanced logistic fits of all labels of an array column: {label: intercept and coefficients} and the scans it took.

    Newton steps for all labels at once: a scan adds up the gradients and curvatures of every label, so a hundred labels take as many
    scans as the slowest of them alone. A step that makes a label worse is halved. ``penalty`` counts in standard deviations of the
    features; a label that all or no rows have gets the intercept +-inf.
    """
    size = len(features) + 1
    if len(features) > MOST_FEATURES or len(vocabulary) * (1 + size + size * size) > MOST_CELLS:
        raise ValueError("too many features or labels for the sums of a pass")
    known = list(vocabulary)
    rows = df.filter(_whole(features)).select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)], F.col(labels).alias("_labels"))
    facts = rows.agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.var_pop(f"_x{i}") for i in range(size - 1)]).cast("array<double>").alias("v"),
        F.array(*[F.count_if(F.array_contains("_labels", F.lit(x))) for x in known]).cast("array<long>").alias("has"),
    ).first()
    n, has = facts["n"], np.array(facts["has"], float)
    usable = (has > 0) & (has < n)
    positive, negative = (np.where(usable, n / (2.0 * np.where(usable, x, 1.0)), 1.0) for x in (has, n - has))
    weight = has * positive + (n - has) * negative
    ridge = np.append(0.0, penalty * np.array([v or 0.0 for v in facts["v"]]))
    beta = np.zeros((size, len(known)))
    before, worst, step = beta.copy(), np.full(len(known), np.inf), np.zeros_like(beta)
    context = df.sparkSession.sparkContext
    scans = 0
    while usable.any() and scans < passes:
        shared = context.broadcast((beta, positive, negative, known))
        cells = rows.mapInArrow(_passed(shared, size), "label int, place int, v double").groupBy("label", "place").agg(F.sum("v").alias("v")).toArrow()
        shared.unpersist()
        scans += 1
        sums = np.zeros((len(known), 1 + size + size * size))
        sums[cells.column("label").to_numpy(), cells.column("place").to_numpy()] = cells.column("v").to_numpy()
        moved = 0.0
        for i in np.nonzero(usable)[0].tolist():
            loss = sums[i, 0] / weight[i] + 0.5 * float(ridge @ beta[:, i] ** 2)
            if loss > worst[i] + 1e-15 and np.abs(step[:, i]).max() > close:
                step[:, i] /= 2.0
                beta[:, i] = before[:, i] + step[:, i]
            else:
                worst[i], before[:, i] = loss, beta[:, i]
                slope = sums[i, 1 : 1 + size] / weight[i] + ridge * beta[:, i]
                bend = sums[i, 1 + size :].reshape(size, size) / weight[i] + np.diag(ridge + 1e-14)
                step[:, i] = -np.linalg.lstsq(bend, slope, rcond=None)[0]
                beta[:, i] = beta[:, i] + step[:, i]
            moved = max(moved, float(np.abs(step[:, i]).max()))
        if moved < close:
            break
    out = {label: beta[:, i].copy() for i, label in enumerate(known)}
    for i in np.nonzero(~usable)[0].tolist():
        out[known[i]] = np.append(np.inf if n and has[i] == n else -np.inf, np.zeros(size - 1))
    return out, scans


def label_logit(line: np.ndarray, features: Sequence[str]) -> Column:
    found = F.lit(float(line[0]))
    for c, v in zip(features, line[1:].tolist()):
        found = found + F.lit(float(v)) * F.col(c).cast("double")
    return found


def label_probabilities(df: DataFrame, fits: dict[object, np.ndarray], features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep`` + ``label`` + ``probability``, a row per label; null where a feature is."""
    each = F.array(*[F.struct(F.lit(label).alias("label"), (1 / (1 + F.exp(-label_logit(line, features)))).alias("probability")) for label, line in fits.items()])
    return df.select(*keep, F.inline(each))


def predicted_labels(df: DataFrame, fits: dict[object, np.ndarray], features: Sequence[str], key: Sequence[str]) -> DataFrame:
    """``key`` + ``labels``: those whose fit says yes, in order."""
    said = [F.when(label_logit(line, features) > 0, F.lit(label)) for label, line in fits.items()]
    return df.select(*key, F.sort_array(F.array_compact(F.array(*said))).alias("labels"))
