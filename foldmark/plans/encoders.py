"""Encoder, text-feature and array-feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldmark.functions import vectors
from foldmark.operators import encode, split, text
from foldmark.plans import query
from foldmark.plans.splits import LIMIT, draw
from foldmark.session import dealt, materialize, shared_dir
from foldmark.tables import table

TEXTS_PER_TASK = 4096
STOP = text.default_stop_words()
STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP)
WORDS_SQL = rf"list_filter(regexp_extract_all(lower(text), '([\p{{L}}\p{{N}}_]{{2,}})', 1), lambda w: w NOT IN ({STOP_SQL}))"


@query(
    "ENC1_label_encode",
    "SELECT p_partkey, dense_rank() OVER (ORDER BY p_type) - 1 AS type_code, dense_rank() OVER (ORDER BY p_name) - 1 AS name_code FROM part",
)
def enc1(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_type", "p_name")
    out = encode.encode(df, encode.fit_dictionary(df, "p_type"), "p_type", "type_code")
    out = encode.encode(out, encode.fit_dictionary(df, "p_name"), "p_name", "name_code")
    return out.select("p_partkey", "type_code", "name_code")


_TRAIN_DICT = f"""WITH t AS (SELECT c_custkey, c_name, CASE WHEN {draw('c_custkey')} < {LIMIT} THEN 'val' ELSE 'train' END AS role FROM customer),
  d AS (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS code FROM t WHERE role = 'train') """


def _customer_roles(spark, sf):
    return split.holdout(table(spark, sf, "customer").select("c_custkey", "c_name"), ["c_custkey"])


@query(
    "ENC2_unknown_token",
    _TRAIN_DICT + "SELECT c_custkey, coalesce(code, (SELECT count(*) FROM d)) AS code FROM t LEFT JOIN d USING (c_name) WHERE role = 'val'",
)
def enc2(spark, sf):
    df = _customer_roles(spark, sf)
    codes = encode.fit_dictionary(df.filter("role = 'train'"), "c_name")
    return encode.encode(df.filter("role = 'val'"), codes, "c_name", "code").select("c_custkey", "code")


@query("ENC3_frozen_categories", _TRAIN_DICT + "SELECT c_custkey, role, code FROM t LEFT JOIN d USING (c_name)")
def enc3(spark, sf):
    df = _customer_roles(spark, sf)
    path = shared_dir(spark, "dictionary")
    encode.save_dictionary(encode.fit_dictionary(df.filter("role = 'train'"), "c_name"), path)
    codes = encode.load_dictionary(spark, path)
    return encode.encode(df, codes, "c_name", "code", unknown="null").select("c_custkey", "role", "code")


_PRIORITIES = "['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW','F','O','P']"


@query(
    "ENC4_multilabel_binarise",
    f"""SELECT o_orderkey, array_to_string(list_transform({_PRIORITIES}, lambda v: CAST(list_contains([o_orderstatus, o_orderpriority], v) AS INT)), '') AS bits,
       array_to_string(list_sort([o_orderstatus, o_orderpriority]), '|') AS back FROM orders""",
)
def enc4(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("labels"))
    vocabulary = encode.fit_vocabulary(df, "labels")
    bits = encode.binarise(F.col("labels"), vocabulary)
    return df.withColumn("bits", bits).select(
        "o_orderkey",
        F.array_join(F.transform("bits", lambda b: b.cast("string")), "").alias("bits"),
        F.array_join(encode.labels_of(F.col("bits"), vocabulary), "|").alias("back"),
    )


@query(
    "ENC4_long_form",
    """WITH l AS (SELECT o_orderkey, unnest([o_orderstatus, o_orderpriority]) AS v FROM orders),
       d AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT v FROM l WHERE v IS NOT NULL))
       SELECT DISTINCT o_orderkey, code FROM l JOIN d USING (v)""",
)
def enc4_long(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("labels"))
    return encode.binarise_long(df, ["o_orderkey"], "labels")


@query(
    "ENC5_one_hot",
    "SELECT vec_id, array_to_string(list_transform(range(10), lambda i: CAST(i = label AS INT)), '') AS bits FROM embeddings",
)
def enc5(spark, sf):
    bits = F.transform(encode.one_hot(F.col("label"), 10), lambda b: b.cast("string"))
    return table(spark, sf, "embeddings").select("vec_id", F.array_join(bits, "").alias("bits"))


@query(
    "ENC6_standard_scale",
    f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, CASE WHEN {draw('l_orderkey')} < {LIMIT} THEN 'val' ELSE 'train' END AS role FROM lineitem),
       s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp FROM t WHERE role = 'train')
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity - mq) / sq, 6) AS q, round((l_extendedprice - mp) / sp, 6) AS p FROM t, s WHERE role = 'val'""",
)
def enc6(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    df = split.holdout(table(spark, sf, "lineitem").select(*keys, "l_quantity", "l_extendedprice"), ["l_orderkey"])
    scaler = encode.fit_scaler(df.filter("role = 'train'"), ["l_quantity", "l_extendedprice"])
    out = encode.scale(df.filter("role = 'val'"), scaler)
    return out.select(*keys, F.round("l_quantity", 6).alias("q"), F.round("l_extendedprice", 6).alias("p"))


_F = "SELECT '{c}' AS feature, round(corr({c}, l_extendedprice) ** 2 / (1 - corr({c}, l_extendedprice) ** 2) * (count(*) - 2), 4) AS f FROM lineitem"


@query("ENC7_univariate_f", " UNION ALL ".join(_F.format(c=c) for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")))
def enc7(spark, sf):
    df = table(spark, sf, "lineitem")
    out = encode.regression_f(df, "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_linenumber"])
    return out.withColumn("f", F.round("f", 4))


@query(
    "TXT1_tokens_bigrams",
    f"""WITH t AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents)
       SELECT doc_id, len(w) AS words, len(w) + greatest(len(w) - 1, 0) AS terms, coalesce(w[1] || ' ' || w[2], '') AS first_pair, coalesce(w[-1], '') AS last_word FROM t""",
)
def txt1(spark, sf):
    words = text.tokens(F.col("text"), STOP)
    df = table(spark, sf, "documents").select("doc_id", "text").select("doc_id", words.alias("w"))
    both = df.select("doc_id", "w", text.with_bigrams(F.col("w")).alias("t"))
    return both.select(
        "doc_id",
        F.size("w").alias("words"),
        F.size("t").alias("terms"),
        F.coalesce(F.get("t", F.size("w")), F.lit("")).alias("first_pair"),
        F.coalesce(F.get("w", F.size("w") - 1), F.lit("")).alias("last_word"),
    )


@query(
    "TXT2_char_ngrams",
    """WITH t AS (SELECT p_partkey, lower(p_name) AS s FROM part), n AS (SELECT unnest([3, 4, 5]) AS n)
       SELECT p_partkey, gram, count(*) AS tf FROM (SELECT p_partkey, substr(s, i, n) AS gram FROM t, n, range(1, 200) r(i) WHERE i + n - 1 <= length(s)) GROUP BY 1, 2""",
)
def txt2(spark, sf):
    return text.gram_counts(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", 3, 5)


@query(
    "TXT3_comma_tokens",
    """SELECT token, count(*) AS n FROM (SELECT unnest(string_split(lower(lang || ',' || source || ',, ' || CAST(doc_id % 3 AS VARCHAR)), ',')) AS token FROM documents)
       WHERE token <> '' GROUP BY 1""",
)
def txt3(spark, sf):
    tags = F.concat("lang", F.lit(","), "source", F.lit(",, "), (F.col("doc_id") % 3).cast("string"))
    df = table(spark, sf, "documents").select(F.explode(text.comma_tokens(tags)).alias("token"))
    return df.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(
    "TXT4_tfidf",
    f"""WITH w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
       g AS (SELECT doc_id, unnest(w || list_transform(list_zip(w[1:len(w) - 1], w[2:len(w)]), lambda p: p[1] || ' ' || p[2])) AS term FROM w),
       tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents),
       v AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 3 AND count(*) <= 0.8 * (SELECT n FROM n) ORDER BY sum(tf) DESC, term LIMIT 500),
       x AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1.0 + n) / (1 + df)) + 1) AS weight FROM tf JOIN v USING (term), n)
       SELECT doc_id, term, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)), 6) AS weight FROM x""",
)
def txt4(spark, sf):
    terms = text.with_bigrams(text.tokens(F.col("text"), STOP))
    docs = dealt(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], TEXTS_PER_TASK)  # the table is one file
    docs = materialize(docs, "documents")
    out = text.tfidf(
        docs, "doc_id", terms,
        min_df=3, max_df=0.8, max_features=500, sublinear=True,
    )
    return out.withColumn("weight", F.round("weight", 6))


@query(
    "TXT5_feature_union",
    r"""WITH tf AS (SELECT p_partkey, term, count(*) AS tf FROM (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '([\p{L}\p{N}_]{2,})', 1)) AS term FROM part) GROUP BY 1, 2),
       n AS (SELECT count(*) AS n FROM part), v AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2),
       x AS (SELECT p_partkey, term, tf * (ln((1.0 + n) / (1 + df)) + 1) AS weight FROM tf JOIN v USING (term), n)
       SELECT p_partkey, 'word__' || term AS feature, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY p_partkey)), 6) AS value FROM x UNION ALL
       SELECT p_partkey, 'num__p_size', CAST(p_size AS DOUBLE) FROM part UNION ALL SELECT p_partkey, 'num__p_retailprice', p_retailprice FROM part""",
)
def txt5(spark, sf):
    df = table(spark, sf, "part")
    words = text.tfidf(df.select("p_partkey", "p_name"), "p_partkey", text.tokens(F.col("p_name")), min_df=2)
    numbers = text.numeric_block(df, "p_partkey", ["p_size", "p_retailprice"])
    return text.feature_union("p_partkey", {"word": words, "num": numbers}).withColumn("value", F.round("value", 6))


@query(
    "IMG1_histogram_features",
    """WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
       b AS (SELECT vec_id, CAST(floor((x + 0.5) / 0.03125) AS INT) AS bin, count(*) AS n FROM e WHERE x >= -0.5 AND x < 0.5 GROUP BY 1, 2),
       h AS (SELECT vec_id, max(n) / sqrt(sum(n * n)) AS peak, count(*) AS filled FROM b GROUP BY 1)
       SELECT e.vec_id, round(peak, 6) AS peak, filled, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max
       FROM e JOIN h ON e.vec_id = h.vec_id GROUP BY e.vec_id, peak, filled""",
)
def img1(spark, sf):
    hist = vectors.unit_length(vectors.histogram(F.col("embedding"), -0.5, 0.5, 32))
    df = table(spark, sf, "embeddings").select("vec_id", "embedding").select(
        "vec_id", hist.alias("h"), *[c.alias(n) for n, c in vectors.array_moments(F.col("embedding")).items()]
    )
    return df.select(
        "vec_id",
        F.round(F.array_max("h"), 6).alias("peak"),
        F.size(F.filter("h", lambda x: x > 0)).alias("filled"),
        *[F.round(n, 6).alias(n) for n in ("mean", "std", "min", "max")],
    )
