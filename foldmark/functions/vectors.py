"""Array columns: scaling, arg-max, top-k, histogram."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once; inside a lambda it would run per element."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def rescale(vector: Column, divisor: float) -> Column:
    return F.transform(vector, lambda x: x.cast("double") / F.lit(float(divisor)))


def flatten_trailing(image: Column) -> Column:
    """Drop the one-element last axis of a nested array: [[[a], [b]]] to [[a, b]]."""
    return F.transform(image, lambda row: F.flatten(row))


def argmax(vector: Column) -> Column:
    """0-based index of the largest value, the first one on ties."""
    return F.array_position(vector, F.array_max(vector)) - 1


def top_indices(vector: Column, k: int) -> Column:
    """0-based indices of the k largest values, best first; equal values keep index order."""
    scored = F.transform(vector, lambda x, i: F.struct(x.alias("x"), (-i).alias("i")))
    return F.transform(F.slice(F.sort_array(scored, asc=False), 1, k), lambda s: -s["i"])


def histogram(vector: Column, low: float, high: float, bins: int) -> Column:
    """Counts of values in [low, high) over equal bins."""
    width = (high - low) / bins
    cells = F.transform(
        F.filter(vector, lambda x: (x >= low) & (x < high)),
        lambda x: F.floor((x.cast("double") - F.lit(low)) / F.lit(width)).cast("int"),
    )
    slots = F.sequence(F.lit(0), F.lit(bins - 1))
    return let(cells, lambda c: F.transform(slots, lambda b: F.size(F.filter(c, lambda x: x == b))))


def unit_length(vector: Column) -> Column:
    """Divide by the Euclidean norm; a zero vector stays."""
    squares = F.aggregate(
        vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"), F.sqrt
    )
    return let(
        squares,
        lambda norm: F.transform(
            vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0))
        ),
    )


def array_moments(vector: Column) -> dict[str, Column]:
    """Mean, population standard deviation, minimum and maximum of an array of numbers."""
    n = F.size(vector)
    mean = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double")) / n
    spread = let(
        mean,
        lambda m: F.aggregate(
            vector, F.lit(0.0), lambda a, x: a + (x.cast("double") - m) * (x.cast("double") - m)
        ),
    )
    return {
        "mean": mean,
        "std": F.sqrt(spread / n),
        "min": F.array_min(vector).cast("double"),
        "max": F.array_max(vector).cast("double"),
    }
