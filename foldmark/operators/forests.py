"""Regression forests and boosted trees over many rows: rows are counted by bins first, and the trees grow on the counts.

A tree sees a row only as the bins of its features, at most ``BINS`` per feature, and its split gains and leaf means are made of sums of
weights and targets. So rows that share all bins are one cell, and a tree needs of a cell the number of its rows in the tree's
bootstrap and their mean target: what is spread inside a cell falls out of every gain. Each row draws its Poisson number for each tree once, in the
one scan that adds up the cells; Spark ML grows each tree on the cells. A fit reads the rows four times at most, whatever the number of
trees and levels, and keeps none of them.

Boosted trees draw nothing. The residuals of the rows of a cell differ by their targets only, so the number of its rows, their mean and their deviation
give the sums of every split and the error of the validation rows, which ends the fit where it ends over the rows: a cell is two rows, at the mean less and plus the deviation.

Counting pays where there are far fewer cells than rows. Other tables, and tables of less than ``LARGE`` rows, are fitted row by row by Spark ML.

Edge cases: rows with a null or NaN among features or target are an error, as in Spark ML. Bins end at quantiles of ``SAMPLE`` rows (Spark ML's of fewer), or hold one value
each where a feature has no more than ``BINS`` among all rows. As in Spark ML, draws follow the partitions of the table.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from functools import reduce
from math import prod
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle, inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldmark.session import forget, materialize, small_side

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

BINS = 32  # per feature, as Spark ML has it
SAMPLE = 1_000_000  # rows whose quantiles end the bins; Spark ML takes ten thousand
LARGE = 1 << 20  # rows from which cells are counted
FEWER = 16  # rows per possible cell, at least
HELD = 1 << 16  # cells a task holds before it passes their sums on
CHUNK = 1 << 16  # rows that draw at a time
AT_ONCE = 4  # trees that grow at the same time
TASK_CELLS = 50_000  # cells in a task of a boosted fit
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.append(1.0, np.arange(1.0, 20.0))))  # distribution function at 0, 1, 2...
_LOW = np.searchsorted(POISSON, np.arange(1 << 16) / (1 << 16), side="right")
_HIGH = np.searchsorted(POISSON, np.arange(1, (1 << 16) + 1) / (1 << 16), side="left")
BY_BITS = np.where(_LOW == _HIGH, _LOW, -1).astype(float)  # the draw by the first 16 bits of a uniform number, -1 where later bits decide


def _odd(name: str) -> Column:
    return F.col(name).isNull() | F.isnan(F.col(name).cast("double"))


def cuts_of(df: DataFrame, features: Sequence[str], target: str, large: int, seed: int) -> list[list[float]] | None:
    """Lower ends of the bins of each feature but the first; none if the rows are to be fitted as they are."""
    values = [F.col(c).cast("double") for c in features]
    shares = [i / BINS for i in range(1, BINS)]
    facts = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(reduce(lambda a, b: a | b, map(_odd, [*features, target]))).alias("odd"),
        F.array(*[F.approx_count_distinct(v) for v in values]).alias("kinds"),
    ).first()
    if facts["n"] < large or facts["odd"]:
        return None
    few = [i for i, kinds in enumerate(facts["kinds"]) if kinds <= 2 * BINS]  # the number is off by a few per cent
    some = df if facts["n"] <= SAMPLE else df.sample(SAMPLE / facts["n"], seed)
    ends = some.agg(F.array(*[F.percentile_approx(v, shares, 10_000) for v in values]).alias("cuts")).first()["cuts"]
    cuts = [sorted(set(c)) for c in ends]
    if few:
        pairs = F.array(*[F.struct(F.lit(i).alias("i"), values[i].alias("v")) for i in few])
        found = df.select(F.explode(pairs).alias("p")).select("p.*").distinct().collect()  # some dozens per feature
        for i in few:
            mine = sorted(r["v"] for r in found if r["i"] == i)
            if len(mine) <= BINS:
                cuts[i] = mine[1:]
    cells = prod(len(c) + 1 for c in cuts)
    return cuts if cells * FEWER <= facts["n"] else None


def _cell(features: Sequence[str], cuts: list[list[float]]) -> Column:
    """Number of the cell of a row; the bin of a feature is the number of its cuts that the value reaches."""
    cell, step = F.lit(0).cast("long"), 1
    for name, ends in zip(features, cuts):
        value = F.col(name).cast("double")
        for end in ends:
            cell += F.when(value >= end, F.lit(step).cast("long")).otherwise(F.lit(0).cast("long"))
        step *= len(ends) + 1
    return cell


def _bins(cuts: list[list[float]]) -> list[Column]:
    """The bins of the features from the number of a cell."""
    out, step = [], 1
    for ends in cuts:
        out.append((F.floor(F.col("cell") / step) % (len(ends) + 1)).cast("double"))
        step *= len(ends) + 1
    return out


def poisson(rng: np.random.Generator, rows: int, trees: int) -> np.ndarray:
    """Poisson numbers of mean 1 by inversion."""
    size = rows * trees
    bits = rng.integers(0, 1 << 64, -(-size // 4), np.uint64).view(np.uint16)[:size]
    out = BY_BITS[bits]
    late = np.nonzero(out < 0)[0]
    out[late] = np.searchsorted(POISSON, (bits[late] + rng.random(len(late))) / (1 << 16), side="right")
    return out.reshape(rows, trees)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cells, in order, and targets of some batches at a time."""
    held: list[pa.RecordBatch] = []

    def out() -> tuple[np.ndarray, np.ndarray]:
        cell, y = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("cell", "y"))
        held.clear()
        order = np.argsort(cell, kind="stable")
        return cell[order], y[order]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            yield out()
    if held:
        yield out()


def _drawn(trees: int, seed: int):
    """Sums of draws, and of targets times draws, per cell and tree. A task holds about ``HELD`` cells at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.Generator(np.random.SFC64([seed & 0xFFFFFFFF, TaskContext.get().partitionId()]))

        def empty() -> tuple[np.ndarray, np.ndarray]:
            return np.zeros(0, np.int64), np.zeros((2, 0, trees))

        def out(cells: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            at, tree = np.nonzero(sums[0])
            return pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(cells[at]), pa.array(sums[0, at, tree]), pa.array(sums[1, at, tree])], ["tree", "cell", "n", "s"])

        cells, sums = empty()
        for cell, y in _chunks(batches):
            here, first = np.unique(cell, return_index=True)
            new = np.setdiff1d(here, cells, assume_unique=True)
            if len(new):
                cells = np.concatenate((cells, new))
                by = np.argsort(cells, kind="stable")
                cells, sums = cells[by], np.concatenate((sums, np.zeros((2, len(new), trees))), axis=1)[:, by]
            at = np.searchsorted(cells, here)
            draws = poisson(rng, len(cell), trees)
            sums[0, at] += np.add.reduceat(draws, first)
            draws *= y[:, None]
            sums[1, at] += np.add.reduceat(draws, first)
            if len(cells) > HELD:
                yield out(cells, sums)
                cells, sums = empty()
        if len(cells):
            yield out(cells, sums)

    return run


class CountedForest(Estimator):
    """A forest that is fitted by cells where these are far fewer than rows, and by ``plain`` where not."""

    def __init__(self, plain: Pipeline, features: Sequence[str], target: str, trees: int, depth: int, seed: int, large: int = LARGE):
        super().__init__()
        self.plain, self.features, self.target = plain, list(features), target
        self.trees, self.depth, self.seed, self.large = trees, depth, seed, large

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        cuts = cuts_of(dataset, self.features, self.target, self.large, self.seed)
        if cuts is None:
            return self.plain.fit(dataset)
        rows = dataset.select(_cell(self.features, cuts).alias("cell"), F.col(self.target).cast("double").alias("y"))
        drawn = rows.mapInArrow(_drawn(self.trees, self.seed), "tree int, cell long, n double, s double")
        sums = drawn.groupBy("tree", "cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        bins = [c.alias(f"_b{i}") for i, c in enumerate(_bins(cuts))]
        cells = sums.select(*bins, "n", (F.col("s") / F.col("n")).alias("y"), "tree").repartition("tree")
        cells = materialize(cells, "forest-cells", ("tree",))
        vectors = VectorAssembler(inputCols=[f"_b{i}" for i in range(len(cuts))], outputCol="features")

        def grown(tree: int) -> RandomForestRegressionModel:
            share = "onethird" if self.trees > 1 else "all"  # what "auto" means for a forest
            one = RandomForestRegressor(
                labelCol="y", weightCol="n", numTrees=1, bootstrap=False, featureSubsetStrategy=share, maxDepth=self.depth, maxBins=BINS, seed=self.seed + tree
            )
            mine = cells.filter(F.col("tree") == tree)  # before the vectors, so that only this tree's files are read
            return one.fit(vectors.transform(mine).select("features", "y", "n"))

        with ThreadPool(AT_ONCE) as pool:
            grow = inheritable_thread_target(dataset.sparkSession)(grown)
            grown_trees = pool.map(grow, range(self.trees))
        forget(cells)
        return PipelineModel([CountedForestModel(self.features, cuts, grown_trees)])


class CountedForestModel(Model):
    """Trees over the cells of the features; the prediction is their mean, found once per cell."""

    def __init__(self, features: list[str], cuts: list[list[float]], models: list[RandomForestRegressionModel]):
        super().__init__()
        self.features, self.cuts, self.models = features, cuts, models

    @property
    def trees(self) -> list:
        return [m.trees[0] for m in self.models]

    @property
    def getNumTrees(self) -> int:
        return len(self.models)

    @property
    def featureImportances(self) -> DenseVector:
        """Those of the trees, each scaled to 1, added up and scaled to 1 again."""
        total = np.sum([m.featureImportances.toArray() for m in self.models], axis=0)
        return DenseVector(total / (total.sum() or 1.0))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        odd = reduce(lambda a, b: a | b, map(_odd, self.features))
        cell = F.when(odd, F.raise_error(F.lit("a feature is null or NaN")).cast("long")).otherwise(_cell(self.features, self.cuts))
        coded = dataset.withColumn("_cell", cell)
        cells = coded.select(F.col("_cell").alias("cell")).distinct()
        cells = cells.select(F.col("cell").alias("_c"), *[c.alias(f"_b{i}") for i, c in enumerate(_bins(self.cuts))])
        scored = VectorAssembler(inputCols=[f"_b{i}" for i in range(len(self.cuts))], outputCol="features").transform(cells)
        for i, model in enumerate(self.models):
            scored = model.setPredictionCol(f"_p{i}").transform(scored)
        mean = reduce(lambda a, b: a + b, [F.col(f"_p{i}") for i in range(len(self.models))]) / len(self.models)
        found = small_side(scored.select("_c", mean.alias("prediction")))
        return coded.join(found, F.col("_cell") == F.col("_c"), "left").drop("_cell", "_c")


class CountedBoost(Estimator):
    """Boosted regression trees that are fitted by cells where these are far fewer than rows, and by ``plain`` where not."""

    def __init__(self, plain: Pipeline, features: Sequence[str], target: str, rounds: int, depth: int, validation: str | None, seed: int, large: int = LARGE):
        super().__init__()
        self.plain, self.features, self.target, self.validation = plain, list(features), target, validation
        self.rounds, self.depth, self.seed, self.large = rounds, depth, seed, large

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        held = F.lit(False) if self.validation is None else F.col(self.validation)
        cuts = cuts_of(dataset.filter(~held), self.features, self.target, self.large, self.seed)
        if cuts is None:
            return self.plain.fit(dataset)
        odd = reduce(lambda a, b: a | b, map(_odd, [*self.features, self.target]))  # among the validation rows, which the cuts have not seen
        cell = F.when(odd, F.raise_error(F.lit("a feature or target is null or NaN")).cast("long")).otherwise(_cell(self.features, cuts))
        y = F.col(self.target).cast("double")
        rows = dataset.select(cell.alias("cell"), y.alias("y"), held.alias("held")).filter("held is not null")
        sums = rows.groupBy("cell", "held").agg(F.count(F.lit(1)).alias("rows"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("spread"))
        both = F.explode(F.array(F.col("mean") - F.col("spread"), F.col("mean") + F.col("spread")))
        cells = materialize(sums.select("cell", "held", (F.col("rows") / 2).alias("n"), both.alias("y")), "boost-cells")
        bins = [c.alias(f"_b{i}") for i, c in enumerate(_bins(cuts))]
        coded = cells.select(*bins, "n", "y", "held").coalesce(max(1, math.ceil(cells.count() / TASK_CELLS)))
        vectors = VectorAssembler(inputCols=[f"_b{i}" for i in range(len(cuts))], outputCol="features")
        model = GBTRegressor(labelCol="y", weightCol="n", maxIter=self.rounds, maxDepth=self.depth, maxBins=BINS, seed=self.seed)
        if self.validation is not None:
            model = model.setValidationIndicatorCol("held")
        fitted = model.fit(vectors.transform(coded).select("features", "n", "y", "held"))
        forget(cells)
        return PipelineModel([CountedBoostModel(self.features, cuts, [fitted])])


class CountedBoostModel(CountedForestModel):
    """Boosted trees over the cells of the features; the prediction is found once per cell."""

    @property
    def trees(self) -> list:
        return self.models[0].trees

    @property
    def getNumTrees(self) -> int:
        return self.models[0].getNumTrees

    @property
    def featureImportances(self) -> DenseVector:
        return self.models[0].featureImportances
