"""Tokens, n-grams and TF-IDF in long form: one row per document and term."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldmark.functions.vectors import let
from foldmark.operators.ordering import positions
from foldmark.session import materialize, shuffle_partitions, small_side

# fixed values: token patterns
WORD = r"([\p{L}\p{N}_]{2,})"
COMMA_TOKEN = r"([^,]+)"
GRAMS_PER_TASK = 1_000_000
BUCKETS = 1 << 16  # of the sketch that bounds how frequent terms are


# fixed values: the English stop words that ship with Spark
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being
have has had having do does did doing a an the and but if or because as until while of at by for with about against
between into through during before after above below to from up down in out on off over under again further then once
here there when where why how all any both each few more most other some such no nor not only own same so than too
very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm
you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't
doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's
there's what's when's where's who's why's would
""".split()


def default_stop_words() -> list[str]:
    """The English list of Spark; it differs a little from other libraries' lists."""
    return list(STOP_WORDS)


def tokens(col: Column, stop_words: Sequence[str] = ()) -> Column:
    """Lower-cased words of two or more word characters, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(WORD), F.lit(1))
    if not stop_words:
        return found
    return F.filter(found, lambda w: ~w.isin(list(stop_words)))


def with_bigrams(words: Column) -> Column:
    """The words followed by all pairs of neighbours."""

    def extend(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        pairs = F.zip_with(
            F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b)
        )
        return F.concat(w, pairs)

    return let(words, extend)


def char_ngrams(col: Column, low: int, high: int) -> Column:
    """All runs of ``low``..``high`` characters, spaces included; white-space runs count as one blank."""
    text = F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"\s\s+", " ")
    return F.concat(
        *[F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in range(low, high + 1)]
    )


def gram_counts(df: DataFrame, doc: str, col: str, low: int, high: int, per_task: int = GRAMS_PER_TASK) -> DataFrame:
    """``doc``, ``gram``, ``tf`` of the runs of ``low``..``high`` characters of a text column.

    Texts move, grams do not: rows are dealt by ``doc`` to as many tasks as hold ``per_task`` grams each on average, so the counts of a
    task take the same memory at any size of the table. Copies of a row are one before they move.
    """
    copies = df.groupBy(doc, col).agg(F.count(F.lit(1)).alias("_copies"))
    grams = (high - low + 1) * (df.agg(F.sum(F.length(col))).first()[0] or 0)
    dealt = copies.repartition(max(shuffle_partitions(df.sparkSession), math.ceil(grams / per_task)), doc)
    each = dealt.select(doc, "_copies", F.explode(char_ngrams(F.col(col), low, high)).alias("gram"))
    return each.groupBy(doc, "gram").agg(F.sum("_copies").alias("tf"))


def comma_tokens(col: Column) -> Column:
    """Lower-cased, non-empty parts between commas, blanks kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(COMMA_TOKEN), F.lit(1))


def _each_term(df: DataFrame, doc: str, terms: Column) -> DataFrame:
    return df.select(doc, F.explode(terms).alias("term"))


def term_counts(df: DataFrame, doc: str, terms: Column) -> DataFrame:
    """``doc``, ``term``, ``tf``. Terms are counted where the text is read, so counts move and texts do not."""
    return _each_term(df, doc, terms).groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))


def _term_stats(counts: DataFrame, n_docs: int, min_df: int, max_df: float, max_features: int | None) -> DataFrame:
    """``term``, ``df``, ``cf`` within the limits, the most frequent in the corpus if limited, ties by term."""
    stats = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    kept = stats.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    return kept if max_features is None else kept.orderBy(F.col("cf").desc(), "term").limit(max_features)


def _with_idf(stats: DataFrame, n_docs: int) -> DataFrame:
    idf = F.ln(F.lit(1.0 + n_docs) / (1 + F.col("df"))) + 1
    return stats.select("term", "df", idf.alias("idf"))


def fit_vocabulary(
    counts: DataFrame, n_docs: int, min_df: int = 1, max_df: float = 1.0, max_features: int | None = None
) -> DataFrame:
    """``term``, ``df``, ``idf``: terms within the document-frequency limits.

    ``max_features`` keeps the terms most frequent in the corpus, ties by term.
    """
    return _with_idf(_term_stats(counts, n_docs, min_df, max_df, max_features), n_docs)


def frequent_terms(
    df: DataFrame, doc: str, terms: Column, max_features: int, min_df: int = 1, max_df: float = 1.0, buckets: int = BUCKETS
) -> tuple[DataFrame, DataFrame]:
    """The same vocabulary as ``fit_vocabulary`` with a limit, and counts (doc, term, tf) that hold all its terms; most terms never move.

    A sketch comes first: terms are counted by hash bucket, a table of fixed size that tasks add up before it moves. A bucket's count
    bounds that of each term in it. Terms of the fullest buckets are then counted exactly; when the last one kept is as
    frequent as any bucket left out is full, no other term can be among the kept. Else the buckets in between are counted as well.
    """
    n_docs = df.count()
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    each = _each_term(df, doc, terms)
    sums = materialize(each.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_most")), "term-buckets")
    least = sums.orderBy(F.col("_most").desc()).limit(4 * max_features).agg(F.min("_most").alias("m")).first()["m"] or 1
    above, counts = None, None
    while True:
        full = F.col("_most") >= least if above is None else (F.col("_most") >= least) & (F.col("_most") < above)
        chosen = F.broadcast(sums.filter(full).select(F.col("_bucket").alias("_b")))  # a number per bucket at most
        part = each.join(chosen, bucket == F.col("_b"), "left_semi").groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))
        part = materialize(part, "term-counts")
        counts = part if counts is None else counts.unionByName(part)
        stats = materialize(_term_stats(counts, n_docs, min_df, max_df, max_features), "vocabulary")
        found = stats.agg(F.count(F.lit(1)).alias("n"), F.min("cf").alias("cf")).first()
        reach = found["cf"] if found["n"] == max_features else 1
        if reach >= least:
            return _with_idf(stats, n_docs), counts
        above, least = least, reach


def weigh(counts: DataFrame, doc: str, sublinear: bool = False, norm: bool = True) -> DataFrame:
    """``doc``, ``term``, ``weight`` from counts with their ``idf``, scaled to unit length per document."""
    tf = 1 + F.ln(F.col("tf")) if sublinear else F.col("tf").cast("double")
    weighted = counts.select(doc, "term", (tf * F.col("idf")).alias("weight"))
    if not norm:
        return weighted
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(doc)))
    return weighted.withColumn("weight", F.col("weight") / length)


def tfidf(
    df: DataFrame,
    doc: str,
    terms: Column,
    min_df: int = 1,
    max_df: float = 1.0,
    max_features: int | None = None,
    sublinear: bool = False,
    norm: bool = True,
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """TF-IDF weights of ``df``; the vocabulary comes from ``fit_on`` (the training rows) if given.

    Counts of the fit are kept and weighed where they serve both; a limited vocabulary meets other rows' terms before they are counted.
    """
    basis = df if fit_on is None else fit_on
    if max_features is None:
        counts = materialize(term_counts(basis, doc, terms), "term-counts")
        vocabulary = fit_vocabulary(counts, basis.count(), min_df, max_df)
    else:
        vocabulary, counts = frequent_terms(basis, doc, terms, max_features, min_df, max_df)
    known = small_side(vocabulary.select("term", "idf"))
    if fit_on is None:
        return weigh(counts.join(known, "term"), doc, sublinear, norm)
    found = _each_term(df, doc, terms).join(known, "term")
    counts = found.groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("idf").alias("idf"))
    return weigh(counts, doc, sublinear, norm)


def feature_union(doc: str, blocks: dict[str, DataFrame]) -> DataFrame:
    """``doc``, ``feature``, ``value`` of several long blocks; names carry the block as a prefix."""
    out = None
    for name, block in blocks.items():
        label, value = [c for c in block.columns if c != doc]
        part = block.select(doc, F.concat(F.lit(f"{name}__"), F.col(label)).alias("feature"), F.col(value).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def numeric_block(df: DataFrame, doc: str, cols: Sequence[str]) -> DataFrame:
    """Numeric columns in long form, to join a feature union."""
    wide = df.select(doc, *[F.col(c).cast("double").alias(c) for c in cols])
    return wide.unpivot(doc, list(cols), "feature", "value").filter(F.col("value").isNotNull())


def to_sparse(long: DataFrame, doc: str, names: DataFrame) -> DataFrame:
    """``doc``, ``indices``, ``values`` arrays for a model fit; ``names`` maps ``feature`` to ``code``."""
    coded = long.join(small_side(names), "feature")
    entries = F.sort_array(F.collect_list(F.struct("code", "value")))  # as long as one document's terms
    return coded.groupBy(doc).agg(entries.alias("e")).select(
        doc, F.transform("e", lambda s: s["code"]).alias("indices"), F.transform("e", lambda s: s["value"]).alias("values")
    )


def feature_codes(long: DataFrame) -> DataFrame:
    """``feature``, ``code``: the feature names in byte order, numbered from 0."""
    names = materialize(long.select("feature").distinct(), "feature-names")
    return positions(names, ["feature"], name="_p").select("feature", (F.col("_p") - 1).alias("code"))
