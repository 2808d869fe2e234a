"""Quality rules with a hashed n-gram log-likelihood ratio.

Words and word pairs of every text fall into hash buckets. Bucket counts of a trusted target (all labelled good
documents) and of the whole raw corpus give two multinomials, both smoothed by ``ALPHA`` per bucket at the
size of the target. The score of a document is the mean log ratio over its n-grams; a document below the threshold is
rejected, as is one that fails the base rules. All of it is built-in expressions: n-grams are exploded, meet the
bucket table, whose size is fixed, in a broadcast join, and are summed per document before anything is shuffled.

Edge cases: a null text has no words; a text with fewer words than ``MIN_WORDS`` fails the base rules, and without any
n-gram its score is 0; without a trusted document all scores are 0, and only the base rules decide; repeated rows are each
judged, and count as often as they stand there; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldmark.llm.common import words
from foldmark.session import materialize, small_side

BUCKETS = 1 << 16
ALPHA = 5.0
THRESHOLD = -0.25  # mean log ratio below which a document is rejected
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def _slot(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(BUCKETS)).cast("int")


def _grams(df: DataFrame) -> DataFrame:
    """One row per word with the bucket of the word and that of the pair it begins; one empty row without words."""
    pairs = F.arrays_zip(F.col("_words").alias("w"), F.slice("_words", 2, F.greatest(F.size("_words"), F.lit(1))).alias("x"))
    rest = [c for c in df.columns if c != "_words"]
    rows = df.select(*rest, F.explode_outer(pairs).alias("_g"))
    word, following = F.col("_g")["w"], F.col("_g")["x"]
    one = F.when(word.isNotNull(), _slot(word))
    two = F.when(following.isNotNull(), _slot(word, following))
    return rows.select(*rest, one.alias("_one"), two.alias("_two"))


def bucket_ratios(docs: DataFrame, trusted: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(slot, ratio) for the buckets that occur; ``trusted`` has the ids of the target in doc_id, as many as there are."""
    marks = trusted.select(F.col("doc_id").alias("_id")).distinct()
    marked = docs.select("doc_id", "text").join(small_side(marks), F.col("doc_id") == F.col("_id"), "left")
    grams = _grams(marked.select(F.col("_id").isNotNull().cast("long").alias("_good"), words(F.col("text")).alias("_words")))
    slots = grams.select("_good", F.explode(F.array("_one", "_two")).alias("slot")).filter("slot is not null")
    counts = materialize(slots.groupBy("slot").agg(F.count(F.lit(1)).alias("raw"), F.sum("_good").alias("good")), "llr")
    raw, good = counts.agg(F.sum("raw"), F.sum("good")).first()
    expected = F.col("raw") * ((good or 0) / (raw or 1))
    return counts.select("slot", F.log((F.col("good") + alpha) / (expected + alpha)).alias("ratio"))


def _repeated(df: DataFrame) -> DataFrame:
    """Replace ``_tri`` (digests of 3-word windows) by n_repeat_words, the words inside windows that occur again."""
    t, m = F.col("_tri"), F.size("_tri")
    placed = F.when(F.size(F.array_distinct(t)) < m, F.sort_array(F.arrays_zip(t.alias("t"), F.sequence(F.lit(1), m).alias("p"))))
    df = df.withColumn("_sorted", placed).drop("_tri")
    df = df.withColumns({"_t": F.col("_sorted").getField("t"), "_p": F.col("_sorted").getField("p")}).drop("_sorted")
    before = F.concat(F.array(F.lit(None).cast("long")), F.slice("_t", 1, F.size("_t") - 1))
    after = F.slice("_t", 2, F.size("_t"))
    near = F.arrays_zip("_t", "_p", before.alias("b"), after.alias("a"))
    twice = F.filter(near, lambda x: F.coalesce(x["_t"] == x["b"], F.lit(False)) | F.coalesce(x["_t"] == x["a"], F.lit(False)))
    df = df.withColumn("_starts", F.sort_array(F.transform(twice, lambda x: x["_p"]))).drop("_t", "_p")
    after = F.slice("_starts", 2, F.greatest(F.size("_starts"), F.lit(1)))
    reach = F.zip_with("_starts", after, lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))).cast("long"))
    covered = F.aggregate(reach, F.lit(0).cast("long"), lambda a, b: a + b)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0))).drop("_starts")


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, the words as ``_words``, and the counts of the base rules."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", text.alias("_text")).withColumn("_words", words(F.col("_text")))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    df = df.withColumn("_lines", lines)
    most = F.greatest(F.size("_words"), F.lit(1))
    longer = F.arrays_zip("_words", F.slice("_words", 2, most).alias("x"), F.slice("_words", 3, most).alias("y"))
    windows = F.transform(F.slice(longer, 1, F.greatest(F.size("_words") - 2, F.lit(0))), lambda z: F.xxhash64(z["_words"], z["x"], z["y"]))
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.translate("_text", BLANKS, "")).cast("long"),
            "n_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_tri": windows,
        }
    )
    return _repeated(df.drop("_text", "_lines"))


def judged(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, base_failed, kept and the mean log ratio of every row of ``docs``."""
    ratios = F.broadcast(bucket_ratios(docs, trusted))
    found = base_counts(docs).withColumn("_row", F.monotonically_increasing_id())
    keys = ["_row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    grams = _grams(found.select(*keys, "_words"))
    for name in ("_one", "_two"):
        side = ratios.select(F.col("slot").alias(f"{name}_slot"), F.col("ratio").alias(f"{name}_ratio"))
        grams = grams.join(side, F.col(name) == F.col(f"{name}_slot"), "left")
    total = F.coalesce(F.sum("_one_ratio"), F.lit(0.0)) + F.coalesce(F.sum("_two_ratio"), F.lit(0.0))
    summed = grams.groupBy(*keys).agg((total / F.greatest(F.count("_one") + F.count("_two"), F.lit(1))).alias("ratio"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return summed.select(*keys[1:], failed.alias("base_failed"), (~failed & (F.col("ratio") >= threshold)).alias("kept"), "ratio")


def trusted_sample(labels: DataFrame) -> DataFrame:
    """The ids of all documents labelled good and not toxic."""
    return labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
