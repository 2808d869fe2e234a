"""Running leaderboard: result files as a stream, one row of totals per (competition, model, language)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmark.operators.leaderboard import RUNS_PER_CELL, relative_score
from foldmark.session import shared_dir

# fixed values: fields of a streamed result
RUN = (
    "submission_id STRING, comp STRING, model STRING, lang STRING, metric STRING, baseline DOUBLE, score DOUBLE, "
    "received TIMESTAMP"
)
KEYS = ["comp", "model", "lang"]


def totals(runs: DataFrame) -> DataFrame:
    """Runs, passed runs, pass rate, mean score and mean relative score; for batches and streams alike."""
    passed = F.count("score")
    ratio = F.when(
        F.col("score").isNotNull(), relative_score(F.col("score"), F.col("baseline"), F.col("metric"))
    )
    return runs.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("runs"),
        passed.alias("passed"),
        (passed / RUNS_PER_CELL * 100).alias("pass_rate"),
        F.avg("score").alias("mean_score"),
        (F.coalesce(F.sum(ratio), F.lit(0.0)) / F.greatest(F.count(ratio), F.lit(RUNS_PER_CELL))).alias("rp"),
    )


def read_runs(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(RUN)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def distinct_runs(stream: DataFrame, late: str | None = None) -> DataFrame:
    """Drop replayed submissions; with ``late``, ids are forgotten once they are older than that."""
    if late is None:
        return stream.dropDuplicates(["submission_id"])
    return stream.withWatermark("received", late).dropDuplicatesWithinWatermark(["submission_id"])


def run_available(
    spark: SparkSession, path: str, files_per_trigger: int | None = None, late: str | None = None
) -> DataFrame:
    """Process all files there are and return the leaderboard after the last batch.

    Every batch replaces the whole leaderboard in its own folder, so a replayed batch writes the same
    rows again; state and progress live in the shared folder.
    """
    root = shared_dir(spark, "running-leaderboard")
    board = totals(distinct_runs(read_runs(spark, path, files_per_trigger), late))
    last: dict[str, int] = {}

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/board/batch={batch_id}")
        last["id"] = batch_id

    query = (
        board.writeStream.outputMode("complete")
        .option("checkpointLocation", f"{root}/state")
        .foreachBatch(store)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if "id" not in last:
        return spark.createDataFrame([], board.schema)
    return spark.read.schema(board.schema).parquet(f"{root}/board/batch={last['id']}")


#: What orders the results of a submission, and what its newest one has.
RESULT = "at LONG, passed BOOLEAN, number DOUBLE, age LONG, comp STRING, model STRING, lang STRING, score DOUBLE, ratio DOUBLE"


def watermarks(rows: DataFrame, late: str) -> list[tuple[int, int, int]]:
    """Of each batch its number, the watermark it ran with and that of the batch before, in ms: ``late`` less than the newest result of earlier batches."""
    newest = rows.groupBy("batch").agg(F.max(F.unix_millis("received")).alias("m"))
    found = newest.select("batch", F.unix_millis(F.timestamp_millis("m") - F.lit(late).cast("interval")).alias("m")).orderBy("batch").collect()  # a row per batch
    out, mark, before = [], 0, 0
    for r in found:
        out.append((r["batch"], mark, before))
        before, mark = mark, max(mark, r["m"] or 0)
    return out


def latest(rows: DataFrame, late: str | None = None) -> DataFrame:
    """What each submission adds to the totals, from the results of all batches: its newest one, whatever their order; of equals the first written.

    With ``late``, results up to the watermark are left out, and a submission that the watermark has passed is let go: its share stays, and a later
    result counts as one more run.
    """
    score, ratio = (F.when(~F.isnan(c), F.col(c)) for c in ("score", "_ratio"))
    rated = F.when(F.col("score").isNotNull(), relative_score(F.col("score"), F.col("baseline"), F.col("metric")))
    values = [F.coalesce(F.unix_micros("received"), F.lit(0)), score.isNotNull(), F.coalesce(score, F.lit(0.0)), -F.unix_micros("written"), F.col("comp"), F.col("model"), F.col("lang"), score, ratio]
    result = F.struct(*[v.alias(f.split()[0]) for v, f in zip(values, RESULT.split(", "))])
    named = rows.filter("submission_id is not null").withColumn("_ratio", rated)
    if late is None:
        best = named.groupBy("submission_id").agg(F.max(result).alias("best"))
    else:
        marks = rows.sparkSession.createDataFrame(watermarks(rows, late), "batch LONG, mark LONG, before LONG")
        timely = named.join(F.broadcast(marks), "batch").filter("received is null or unix_micros(received) > 1000 * mark")
        each = timely.repartition("submission_id").groupBy("submission_id", "batch").agg(F.max(result).alias("best"), F.first("mark").alias("mark"), F.first("before").alias("before"))
        found = each.groupBy("submission_id").agg(F.sort_array(F.collect_list(F.struct("batch", "mark", "before", "best"))).alias("found"))
        kind = f"STRUCT<{RESULT}>"
        start = F.expr(f"named_struct('best', cast(null as {kind}), 'until', cast(null as long), 'done', cast(array() as array<{kind}>))")

        def step(state: Column, x: Column) -> Column:
            gone = F.coalesce(state["until"] < x["before"], F.lit(False))
            newer = gone | state["best"].isNull() | (F.struct(*[x["best"][c] for c in ("at", "passed", "number")]) > F.struct(*[state["best"][c] for c in ("at", "passed", "number")]))
            until = F.when(newer, F.greatest(F.floor(x["best"]["at"] / 1000).cast("long"), x["mark"] + 1))  # a replay alone keeps a submission
            done = F.when(gone, F.array_append(state["done"], state["best"])).otherwise(state["done"])
            return F.struct(F.when(newer, x["best"]).otherwise(state["best"]).alias("best"), until.alias("until"), done.alias("done"))

        best = found.select(F.explode(F.aggregate("found", start, step, lambda state: F.array_append(state["done"], state["best"]))).alias("best"))
    return best.select(
        *[F.col(f"best.{c}").alias(c) for c in KEYS], F.lit(1).cast("long").alias("runs"), F.col("best.passed").cast("long").alias("passed"),
        F.coalesce("best.score", F.lit(0.0)).alias("score"), F.coalesce("best.ratio", F.lit(0.0)).alias("ratio"), F.col("best.ratio").isNotNull().cast("long").alias("rated"),
    )


def corrected_totals(shares: DataFrame) -> DataFrame:
    """The leaderboard from all shares, in the columns of ``totals``; cells that corrections have emptied are gone."""
    sums = shares.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("runs", "passed", "score", "ratio", "rated")]).filter("runs > 0")
    return sums.select(
        *KEYS, "runs", "passed", (F.col("passed") / RUNS_PER_CELL * 100).alias("pass_rate"), F.try_divide("score", "passed").alias("mean_score"),
        (F.col("ratio") / F.greatest("rated", F.lit(RUNS_PER_CELL))).alias("rp"),
    )


def run_corrected(spark: SparkSession, path: str, files_per_trigger: int | None = None, late: str | None = None) -> DataFrame:
    """Process all files there are; results of a submission replace each other by the time they were received.

    Every batch adds its results in a folder of its own, so a replayed batch writes the same again; submissions meet once, when all batches stand.
    """
    root = shared_dir(spark, "corrected-leaderboard")

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/results/batch={batch_id}")

    runs = read_runs(spark, path, files_per_trigger).select("*", F.col("_metadata.file_modification_time").alias("written"))
    writer = runs.writeStream.option("checkpointLocation", f"{root}/state")
    writer.foreachBatch(store).trigger(availableNow=True).start().awaitTermination()
    schema = f"{RUN}, written TIMESTAMP, batch LONG"
    try:
        rows = spark.read.schema(schema).parquet(f"{root}/results")
    except AnalysisException:  # no batch had any row
        rows = spark.createDataFrame([], schema)
    return corrected_totals(latest(rows, late))
