"""Column functions on the awkward values."""

import math

from pyspark.sql import functions as F

from foldmark.functions import dates, text, values, vectors
from foldmark.operators import clean, encode
from foldmark.operators import text as terms


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_list_literals(spark):
    cases = {
        "[u'drama', u'comedy']": ["drama", "comedy"],
        "[u'a', \"b\"]": ["a", "b"],
        "['a, b', 'c']": ["a, b", "c"],
        "[a, b": ["[a, b"],
        "[a, b]": ["a", "b"],
        " x ": ["x"],
        "[]": [],
        None: ["nan"],
    }
    got = one(spark, [(k,) for k in cases], "s string", text.parse_list_literal(F.col("s")))
    assert [r[0] for r in got] == list(cases.values())


def test_int_lists_and_counts(spark):
    rows = [(" 1  2 ",), ("",), ("a 3",), (None,)]
    got = one(spark, rows, "s string", text.parse_ints(F.col("s")), text.word_total(F.col("s")), text.comma_count(F.col("s")))
    assert got == [([1, 2], 2, 1), ([], 0, 0), ([3], 2, 1), ([], 0, 0)]


def test_numbers_from_text(spark):
    rows = [("1.5",), ("x",), ("1d",), ("nan",), (" 7 ",), ("inf",)]
    got = [r[0] for r in one(spark, rows, "s string", values.as_number(F.col("s")))]
    assert got == [1.5, None, None, None, 7.0, math.inf]
    assert one(spark, [("3,25",)], "s string", values.as_number(F.col("s"), ",")) == [(3.25,)]


def test_engines(spark):
    rows = [("172.0HP 1.6L 4 Cylinder Engine",), ("V6 Gas",), ("V12",), ("electric",), (None,)]
    e = F.col("s")
    got = one(
        spark, rows, "s string", text.extract_number(e, text.HORSEPOWER), text.extract_number(e, text.LITRES), text.cylinders(e)
    )
    assert got == [(172.0, 1.6, 4.0), (None, None, 6.0), (None, None, 12.0), (None, None, None), (None, None, None)]


def test_text_statistics(spark):
    stats = text.text_statistics(F.col("s"))
    names = ["char_count", "word_count", "sentence_count", "exclamation_count", "question_count"]
    got = one(spark, [("Hi there. Ok!?",), ("",), (None,)], "s string", *[stats[n] for n in names])
    assert got == [(14, 3, 3, 1, 1), (0, 0, 1, 0, 0), (0, 0, 1, 0, 0)]
    assert one(spark, [("ÄbC",)], "s string", stats["capital_ratio"], stats["mean_word_length"]) == [(2 / 3, 3.0)]


def test_rounding_and_delays(spark):
    rows = [(0.5,), (1.5,), (2.5,)]
    assert [r[0] for r in one(spark, rows, "x double", values.half_even(F.col("x")))] == [0.0, 2.0, 2.0]
    rows = [("2024-01-02 00:00:00", "2024-01-01 12:00:00"), ("2024-01-01", "2024-01-03 01:00:00")]
    got = one(spark, rows, "a string, b string", dates.delay_days(F.col("a").cast("timestamp"), F.col("b").cast("timestamp")))
    assert [r[0] for r in got] == [-1, 2]
    assert one(spark, [("2008-09",), ("n/a",)], "s string", dates.year_prefix(F.col("s"))) == [(2008,), (None,)]


def test_arrays(spark):
    v = F.col("v")
    rows = [([0.1, 0.7, 0.7, 0.2],)]
    got = one(spark, rows, "v array<double>", vectors.argmax(v), vectors.top_indices(v, 3), vectors.histogram(v, 0.0, 1.0, 4))
    assert got == [(1, [1, 2, 3], [2, 0, 2, 0])]
    zero = one(spark, [([0.0, 0.0],)], "v array<double>", vectors.unit_length(v))
    assert zero == [([0.0, 0.0],)]


def test_haversine(spark):
    d = values.haversine_m(*[F.col(c) for c in "abcd"])
    got = one(spark, [(0.0, 0.0, 0.0, 1.0)], "a double, b double, c double, d double", d)[0][0]
    assert math.isclose(got, 6371000 * math.pi / 180, rel_tol=1e-9)


def test_fills_ignore_nan_and_use_the_fit_rows(spark):
    df = values.nan_to_null(spark.createDataFrame([(1.0, "b"), (float("nan"), "a"), (4.0, None)], "x double, s string"))
    assert clean.fit_medians(df, ["x"]) == {"x": 2.5}
    assert clean.fit_modes(df, ["s"]) == {"s": "a"}
    filled = clean.fill(df, {"x": 9.0, "s": "a"})
    assert [r["x"] for r in filled.collect()] == [1.0, 9.0, 4.0]


def test_dictionary_codes_and_unknowns(spark):
    train = spark.createDataFrame([("b",), ("a",), ("é",)], "s string")
    codes = encode.fit_dictionary(train, "s")
    new = spark.createDataFrame([("a",), ("é",), ("zz",), (None,)], "s string")
    got = {r["s"]: r["c"] for r in encode.encode(new, codes, "s", "c").collect()}
    assert got == {"a": 0, "é": 2, "zz": 3, None: 3}
    got = {r["s"]: r["c"] for r in encode.encode(new, codes, "s", "c", unknown="null").collect()}
    assert got["zz"] is None and got["a"] == 0


def test_constant_column_scales_by_one(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r["x"] for r in encode.scale(df, encode.fit_scaler(df, ["x"])).collect()] == [0.0, 0.0]


def test_label_limit_is_an_error(spark):
    import pytest

    df = spark.createDataFrame([(["a", "b"],)], "l array<string>")
    with pytest.raises(ValueError):
        encode.fit_vocabulary(df, "l", max_labels=1)


def test_long_form_of_labels(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b", None]), (2, []), (3, None), (4, ["c"])], "k int, l array<string>")
    rows = sorted((r["k"], r["code"]) for r in encode.binarise_long(df, ["k"], "l").collect())
    assert rows == [(1, 0), (1, 1), (4, 2)]
    seen = encode.label_dictionary(df.filter("k = 4"), "l")
    assert [tuple(r) for r in encode.binarise_long(df, ["k"], "l", seen).collect()] == [(4, 0)]


def test_tokens_and_ngrams(spark):
    got = one(
        spark, [("The Cat, sat a\t mat",)], "s string",
        terms.with_bigrams(terms.tokens(F.col("s"), ["the"])), terms.char_ngrams(F.lit("ab  c"), 3, 4),
    )
    assert got == [(["cat", "sat", "mat", "cat sat", "sat mat"], ["ab ", "b c", "ab c"])]


def test_tfidf_against_hand_values(spark):
    df = spark.createDataFrame([(1, "red red blue"), (2, "red"), (3, "blue green")], "d int, s string")
    out = terms.tfidf(df, "d", terms.tokens(F.col("s")))
    got = {(r["d"], r["term"]): r["weight"] for r in out.collect()}
    idf = lambda n: math.log(4 / (1 + n)) + 1
    norm = math.hypot(2 * idf(2), idf(2))
    assert math.isclose(got[1, "red"], 2 * idf(2) / norm) and math.isclose(got[2, "red"], 1.0)
    assert math.isclose(got[3, "green"], idf(1) / math.hypot(idf(1), idf(2)))
    fitted = terms.tfidf(df.filter("d = 3"), "d", terms.tokens(F.col("s")), fit_on=df.filter("d < 3"))
    assert [r["term"] for r in fitted.collect()] == ["blue"]


def test_feature_union_to_sparse(spark):
    df = spark.createDataFrame([(1, 2.0, "a b1"), (2, 3.0, "b1")], "d int, x double, s string")
    long = terms.feature_union(
        "d", {"w": terms.tfidf(df, "d", terms.tokens(F.col("s"))), "n": terms.numeric_block(df, "d", ["x"])}
    )
    sparse = {r["d"]: (r["indices"], r["values"]) for r in terms.to_sparse(long, "d", terms.feature_codes(long)).collect()}
    assert sparse == {1: ([0, 1], [2.0, 1.0]), 2: ([0, 1], [3.0, 1.0])}
