"""Text expressions: extraction, statistics, list literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns of the parsed text formats
TAG = r"<[^>]+>"
PARENTHESES = r"\([^)]*\)"
SENTENCE_END = r"[.!?]+"
HORSEPOWER = r"(\d+\.?\d*)HP"
LITRES = r"(\d+\.?\d*)L"
CYLINDERS = r"(\d+)\s*Cylinder"
GEARS = r"(\d+)-Speed"
V_ENGINES = {"V6": 6, "V8": 8, "V10": 10, "V12": 12}


def strip(col: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def extract_number(col: Column, pattern: str) -> Column:
    """First group of the first match as a number; NULL without a match."""
    return F.nullif(F.regexp_extract(col, pattern, 1), F.lit("")).try_cast("double")


def cylinders(col: Column) -> Column:
    """Cylinder count from 'N Cylinder', else from the V-engine marks in ascending order."""
    out = extract_number(col, CYLINDERS)
    for mark, count in V_ENGINES.items():
        out = F.coalesce(out, F.when(F.contains(col, F.lit(mark)), F.lit(float(count))))
    return out


def strip_tags(col: Column) -> Column:
    return F.lower(F.regexp_replace(col, TAG, ""))


def without_parentheses(col: Column) -> Column:
    return strip(F.regexp_replace(col, PARENTHESES, ""))


def joined(separator: str, *cols: Column, null_if_missing: bool = False) -> Column:
    """Concatenation; a missing part counts as empty unless it should void the result."""
    if null_if_missing:
        pieces = [p for c in cols for p in (F.lit(separator), c)][1:]
        return F.concat(*pieces)
    pieces = [p for c in cols for p in (F.lit(separator), F.coalesce(c, F.lit("")))][1:]
    return F.concat(*pieces)


def words(col: Column) -> Column:
    """Parts between runs of white space."""
    return F.filter(F.split(col, r"\s+"), lambda w: w != "")


def text_statistics(col: Column, prefix: str = "") -> dict[str, Column]:
    """Lengths, counts and ratios of one text column; a missing text counts as empty."""
    text = F.coalesce(col, F.lit(""))
    tokens = words(text)
    total = F.length(text)
    count = F.size(tokens)
    letters = F.aggregate(tokens, F.lit(0).cast("bigint"), lambda a, w: a + F.length(w))
    capitals = F.regexp_count(text, F.lit(r"\p{Lu}"))
    return {
        f"{prefix}char_count": total,
        f"{prefix}word_count": count,
        f"{prefix}sentence_count": F.regexp_count(text, F.lit(SENTENCE_END)) + 1,
        f"{prefix}mean_word_length": F.when(count > 0, letters / count).otherwise(F.lit(0.0)),
        f"{prefix}capital_ratio": F.when(total > 0, capitals / total).otherwise(F.lit(0.0)),
        f"{prefix}exclamation_count": F.regexp_count(text, F.lit("!")),
        f"{prefix}question_count": F.regexp_count(text, F.lit(r"\?")),
    }


def comma_count(col: Column) -> Column:
    """Number of comma-separated entries; 0 for missing or empty text."""
    return F.when(F.coalesce(col, F.lit("")) == "", 0).otherwise(F.size(F.split(col, ",")))


def base_name(col: Column) -> Column:
    return F.element_at(F.split(col, "/"), -1)


def first_part(col: Column, separator: str = "_") -> Column:
    return F.split_part(col, F.lit(separator), F.lit(1))


def parent_name(col: Column) -> Column:
    """Name of the folder a path lies in; empty if there is none."""
    return F.regexp_extract(col, r"([^/]+)/[^/]*$", 1)


def parse_list_literal(col: Column) -> Column:
    """"[u'a', 'b']" to an array; other text is one label; NULL is the label 'nan'.

    Quoted items keep the commas inside them. A list without quotes is split at commas, and an
    unreadable one with nothing in it is kept whole as a single label.
    """
    text = strip(col)
    is_list = col.startswith("[") & col.endswith("]")
    body = F.substr(col, F.lit(2), F.greatest(F.length(col) - 2, F.lit(0)))
    quoted = r"""^\s*(?:u?'[^']*'|u?"[^"]*")(?:\s*,\s*(?:u?'[^']*'|u?"[^"]*"))*\s*,?\s*$"""
    tokens = F.regexp_extract_all(body, F.lit(r"""('[^']*'|"[^"]*")"""), F.lit(1))
    unquoted = F.transform(tokens, lambda t: F.substr(t, F.lit(2), F.length(t) - 2))
    bare = F.replace(F.replace(F.replace(body, F.lit("u'"), F.lit("")), F.lit("'"), F.lit("")), F.lit('"'), F.lit(""))
    loose = F.filter(F.transform(F.split(bare, ","), strip), lambda t: t != "")
    loose = F.when(F.size(loose) > 0, loose).otherwise(F.array(text))
    empty = F.array().cast("array<string>")
    return (
        F.when(col.isNull(), F.array(F.lit("nan")))
        .when(is_list & (strip(body) == ""), empty)
        .when(is_list & body.rlike(quoted), unquoted)
        .when(is_list, loose)
        .otherwise(F.array(text))
    )


def parse_ints(col: Column) -> Column:
    """White-space separated integers to an array; other tokens and too large ones are dropped; NULL gives []."""
    digits = F.filter(F.split(F.coalesce(col, F.lit("")), r"\s+"), lambda w: w.rlike("^[0-9]+$"))
    return F.filter(F.transform(digits, lambda w: w.try_cast("bigint")), lambda n: n.isNotNull())


def word_total(col: Column) -> Column:
    """Number of white-space separated parts, 0 for empty text."""
    return F.size(words(F.coalesce(col, F.lit(""))))


def loose_json(col: Column, schema: str) -> Column:
    """JSON written with single quotes."""
    return F.from_json(F.replace(col, F.lit("'"), F.lit('"')), schema)
