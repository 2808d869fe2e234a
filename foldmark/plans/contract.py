"""User-code queries: a submission, a splitter, a metric and a row function."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldmark.operators import contract, models, split
from foldmark.operators.metrics import registry
from foldmark.plans import query
from foldmark.plans.models import _FITS, folded_orders
from foldmark.plans.splits import draw
from foldmark.tables import table

SUBMISSION = {
    "train": lambda df: models.linear(["x"], "y").fit(df),
    "prepare_val": lambda model, df: df,
    "predict": lambda model, df: models.predict(model, df, ["o_orderkey"]),
}


@query(
    "UDF1_submission",
    _FITS + "SELECT fold, round(sqrt(avg((y - prediction) ** 2)), 3) AS score, true AS success, CAST(NULL AS VARCHAR) AS error, 0 AS unmatched FROM p GROUP BY 1",
)
def udf1(spark, sf):
    folds = split.expand_folds(folded_orders(spark, sf), 3)
    out = contract.evaluate_submission(SUBMISSION, folds, ["o_orderkey"], "y", "root_mean_squared_error", 3)
    return out.withColumn("score", F.round("score", 3))


@query(
    "UDF2_custom_split",
    f"SELECT o_orderkey, 0 AS fold, CASE WHEN {draw('o_custkey')} % 10 < 3 THEN 'val' ELSE 'train' END AS role FROM orders",
)
def udf2(spark, sf):
    def by_customer(df):
        drawn = split.kfold(df, ["o_custkey"], 10)
        return drawn.withColumns({"role": F.when(F.col("fold") < 3, "val").otherwise("train"), "fold": F.lit(0)})

    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return contract.custom_split(df, by_customer, ["o_custkey"]).drop("o_custkey")


@query(
    "UDF3_custom_metric",
    "SELECT l_returnflag, round(max(abs(l_extendedprice - l_quantity * 1500)), 4) AS score, 0 AS bad_rows FROM lineitem GROUP BY 1",
)
def udf3(spark, sf):
    registry.register_metric("max_error", lambda y, p: F.max(F.abs(y - p)))
    df = table(spark, sf, "lineitem").withColumn("p", F.col("l_quantity") * 1500)
    return registry.score(df, "max_error", "l_extendedprice", "p", ["l_returnflag"]).withColumn("score", F.round("score", 4))


@query(
    "UDF4_row_function",
    "SELECT p_partkey, len(list_distinct(string_split(p_name, ''))) + p_size AS mixed FROM part",
)
def udf4(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    letters = F.size(F.array_distinct(F.split("p_name", "")))
    return df.select("p_partkey", (letters + F.col("p_size")).cast("bigint").alias("mixed"))
