"""Leakage analytics over submission reports: header and HTML fields, enclosing functions, rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldmark.functions.text import base_name, first_part, strip
from foldmark.functions.vectors import let

# fixed values: report markers
DOCSTRING_END = '"""'
BAD_HEADER = "BAD_HEADER_FORMAT"
COUNTERS = {
    "preprocessing_leakage": "Pre-processing leakage",
    "overlap_leakage": "Overlap leakage",
    "no_independence": "No independence test data",
}
SUMMARY_TABLE = r"""(?is)<table[^>]*class\s*=\s*["']?(?:[^"'>]*\s)?sum(?:\s[^"'>]*)?["']?[^>]*>(.*?)</table>"""
RED_BUTTON = r"""(?is)<button[^>]*style\s*=\s*["'][^"']*background-color: red[^"']*["'][^>]*>(.*?)</button>"""
LINE_BUTTONS = {
    "highlight_lines": "highlight train/test sites",
    "mark_leak_lines": "show and go to first leak src",
}

LOWEST = 6  # smaller blocks cost more rows than the lines they sort out
LEVELS = 61  # blocks of the containment join have up to 2 to this lines


def _comment(line: Column) -> Column:
    """Text of a '# ...' line."""
    return strip(F.regexp_replace(strip(line), "^#+", ""))


def parse_headers(reports: DataFrame, text: str = "text") -> DataFrame:
    """Original path, entrypoint status, error status and traceback from the head of a submission.

    The traceback runs from line 4 to the closing quotes; none if the quotes come at once.
    """
    lines = F.split(F.col(text), "\n")
    rest = F.slice(lines, F.lit(4), F.greatest(F.size(lines) - 3, F.lit(1)))
    stop = F.array_position(rest, DOCSTRING_END)
    body = F.when(stop > 0, F.slice(rest, F.lit(1), (stop - 1).cast("int"))).otherwise(rest)
    enough = F.size(lines) >= 4
    trace = F.when(
        enough & (F.get(lines, F.lit(3)) != DOCSTRING_END), F.concat(F.array_join(body, " "), F.lit(" "))
    )
    return reports.withColumns(
        {
            "original_file_path": _comment(F.get(lines, F.lit(0))),
            "entrypoint_status": F.coalesce(_comment(F.get(lines, F.lit(1))), F.lit("")),
            "error_status": F.when(enough, F.substring(F.get(lines, F.lit(2)), 4, 1 << 30)).otherwise(BAD_HEADER),
            "traceback": trace,
        }
    )


def _inner_text(html: Column) -> Column:
    """Text of an HTML fragment without tags, with the common entities resolved."""
    plain = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    # fixed values: character references
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(char))
    return plain


def leakage_counts(html: Column) -> Column:
    """Struct of the summary table's counters; 0 if a row is missing or holds no integer, the last row wins."""
    rows = F.regexp_extract_all(F.regexp_extract(html, SUMMARY_TABLE, 1), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(
        F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))),
        lambda r: F.transform(
            F.regexp_extract_all(r, F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1)), lambda c: strip(_inner_text(c))
        ),
    )

    def counter(table: Column, label: str) -> Column:
        hits = F.filter(
            table,
            lambda c: (F.size(c) >= 2)
            & F.contains(F.get(c, F.lit(0)), F.lit(label))
            & F.get(c, F.lit(1)).rlike(r"^[+-]?\d+$"),
        )
        last = F.try_element_at(F.transform(hits, lambda c: F.get(c, F.lit(1)).cast("int")), F.lit(-1))
        return F.coalesce(last, F.lit(0))

    return let(cells, lambda t: F.struct(*[counter(t, label).alias(name) for name, label in COUNTERS.items()]))


def red_buttons(html: Column) -> Column:
    """Texts of the buttons with a red background."""
    return F.transform(F.regexp_extract_all(html, F.lit(RED_BUTTON), F.lit(1)), _inner_text)


def button_lines(html: Column, call: str) -> Column:
    """Line numbers in the onclick call of the matching buttons, in page order."""
    label = LINE_BUTTONS[call]
    buttons = F.regexp_extract_all(html, F.lit(r"(?is)(<button\b[^>]*>[^<]*</button>)"), F.lit(1))
    wanted = F.filter(buttons, lambda b: F.contains(b, F.lit(label)))
    lists = F.transform(wanted, lambda b: F.regexp_extract(b, rf"{call}\(\[(.+?)\]\)", 1))
    numbers = F.transform(lists, lambda s: F.regexp_extract_all(s, F.lit(r"(\d+)"), F.lit(1)))
    return F.filter(F.transform(F.flatten(numbers), lambda d: d.try_cast("int")), lambda n: n.isNotNull())


def parse_reports(reports: DataFrame, html: str = "html") -> DataFrame:
    """All HTML fields; they stay NULL for a report without a page."""
    page = F.col(html)
    counted = reports.withColumn("_counts", F.when(page.isNotNull(), leakage_counts(page)))
    fields = {
        **{name: F.col(f"_counts.{name}") for name in COUNTERS},
        "highlight_lines": button_lines(page, "highlight_lines"),
        "mark_leak_lines": button_lines(page, "mark_leak_lines"),
        "warnings": red_buttons(page),
    }
    return counted.withColumns({n: F.when(page.isNotNull(), c) for n, c in fields.items()}).drop("_counts")


def pair_reports(py: DataFrame, html: DataFrame, path: str = "path") -> DataFrame:
    """Each submission with its page, matched on the path without its ending; no page gives NULLs."""
    pages = html.select(
        F.regexp_replace(path, r"\.html$", "").alias("_stem"), F.col(path).alias("html_file_path"), F.col("text").alias("html")
    )
    code = py.filter(F.col(path).endswith(".py") & ~F.col(path).endswith(".ir.py"))
    code = code.withColumn("_stem", F.regexp_replace(path, r"\.py$", ""))
    return code.join(pages, "_stem", "left").drop("_stem").withColumnRenamed(path, "python_file_path")


def dyadic_blocks(start: Column, end: Column, levels: int = LEVELS, low: int = 0) -> Column:
    """The span from start to end, both included, as blocks (level, number) of 2 ** level lines, at most two per level.

    With ``low`` no block is smaller than 2 ** low lines, and those at the ends may hold up to 2 ** low - 1 lines more than the span.
    """
    first, last = (F.call_function("shiftright", x, F.lit(low)) for x in (start, end))

    def at(level: Column) -> Column:
        left = -F.call_function("shiftright", -first, level)  # rounded up
        right = F.call_function("shiftright", last + 1, level)
        odd = [F.when(x.bitwiseAND(F.lit(1)) == 1, y) for x, y in ((left, left), (right, right - 1))]
        ends = F.filter(F.array(*odd), lambda x: x.isNotNull() & (left < right))
        return F.transform(ends, lambda x: F.struct((level + F.lit(low)).alias("_level"), x.alias("_number")))

    highest = F.least(F.ceil(F.log2((last - first + 2).cast("double"))).cast("int"), F.lit(levels))  # no larger block fits
    return F.flatten(F.transform(F.sequence(F.lit(0), highest), at))


def enclosing_functions(lines: DataFrame, functions: DataFrame) -> DataFrame:
    """Functions of ``functions(file, name, args, start_line, end_line)`` that contain a line of ``lines(file, line)``.

    A span, cut to the lines there are, becomes dyadic blocks of 2 ** LOWEST lines or more, and a line asks for the one block of each level it
    lies in, so that both sides meet in an equi-join: 2 log n rows per span, however long or broken, log n per line, and a file with very many
    lines or functions spreads over its blocks. A line lies in at most one block of a span; only the blocks at its two ends hold others, 2 ** LOWEST - 1
    each at most, which the bounds sort out. Lines are distinct before the join, and only keys and bounds of spans move with the blocks.
    One row per file and start line, the last function winning, with its lines in order: never more than the function is long.
    """
    marks = lines.select("file", F.col("line").cast("bigint").alias("line")).distinct()
    edge = lines.agg(F.min(F.col("line").cast("bigint")), F.max(F.col("line").cast("bigint"))).first()
    rest = [c for c in functions.columns if c not in ("file", "start_line")]
    last = F.struct("end_line", "name")
    best = F.max(last) if set(rest) == {"end_line", "name"} else F.max_by(F.struct(*rest), last)  # what moves is half as wide
    unique = functions.groupBy("file", "start_line").agg(best.alias("_f")).select("file", "start_line", *[F.col(f"_f.{c}") for c in rest])
    start, end = F.greatest(F.col("start_line").cast("bigint"), F.lit(edge[0]).cast("bigint")), F.least(F.col("end_line").cast("bigint"), F.lit(edge[1]).cast("bigint"))

    def cut(df: DataFrame) -> DataFrame:
        held = df.filter(F.col("end_line") >= F.col("start_line")).select("file", "start_line", start.alias("_from"), end.alias("_to"))
        return held.filter("_from <= _to").select("*", F.inline(dyadic_blocks(F.col("_from"), F.col("_to"), low=LOWEST)))

    levels = cut(functions).agg(F.sort_array(F.collect_set("_level"))).first()[0]  # at most LEVELS + 1 numbers
    asked = F.transform(F.lit(levels).cast("array<int>"), lambda k: F.struct(k.alias("_level"), F.call_function("shiftright", F.col("line"), k).alias("_number")))
    found = marks.select("*", F.inline(asked)).join(cut(unique), ["file", "_level", "_number"]).filter("line BETWEEN _from AND _to")
    held = found.groupBy("file", "start_line").agg(F.sort_array(F.collect_list("line")).alias("contains_lines"))
    return unique.join(held, ["file", "start_line"]).select("file", "start_line", *rest, "contains_lines")


def with_model(df: DataFrame, path: str = "python_file_path") -> DataFrame:
    """Reports that have a page, with the model: the file name up to the first underscore."""
    return df.dropna(subset=["html_file_path"]).withColumn("model", first_part(base_name(F.col(path))))


def leakage_rate(df: DataFrame, by: Sequence[str] = (), count: str = "preprocessing_leakage") -> DataFrame:
    """Files, leaking files and their share."""
    leaks = F.count_if(F.col(count) != 0)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("files"), leaks.alias("leaking"), (leaks / F.count(F.lit(1))).alias("rate")
    )


def function_signatures(df: DataFrame, functions: str = "funcs") -> DataFrame:
    """Names, argument counts and signatures of an array<struct<name, args: array<string>>> column."""
    f = F.col(functions)

    def signature(s: Column) -> Column:
        quoted = F.transform(s["args"], lambda a: F.concat(F.lit("'"), a, F.lit("'")))
        return F.concat(s["name"], F.lit("(["), F.array_join(quoted, ", "), F.lit("])"))

    return df.withColumns(
        {
            "func_name": F.transform(f, lambda s: s["name"]),
            "func_n_args": F.transform(f, lambda s: F.size(s["args"])),
            "n_funcs": F.size(f),
            "func_sig": F.transform(f, signature),
        }
    )


def is_false_positive() -> Column:
    """Exactly one function, and it takes one argument or is named train."""
    return (F.col("n_funcs") == 1) & (
        (F.get("func_n_args", F.lit(0)) == 1) | (F.get("func_name", F.lit(0)) == "train")
    )


def corrected_rate(df: DataFrame, by: Sequence[str] = (), count: str = "preprocessing_leakage") -> DataFrame:
    """Leaking files without the false positives, over all files."""
    leaks = F.count_if(F.col(count) != 0)
    false = F.count_if(is_false_positive())
    files = F.count(F.lit(1))
    return df.groupBy(*by).agg(
        files.alias("files"), leaks.alias("leaking"), false.alias("false_positives"),
        (leaks - false).alias("remaining"), ((leaks - false) / files).alias("rate"),
        F.try_divide(false, leaks).alias("false_positive_rate"),
    )


def remaining_reports(df: DataFrame, key: str, count: str = "preprocessing_leakage") -> DataFrame:
    """Leaking reports that are no false positive, by anti join on the report key."""
    trivial = df.filter(is_false_positive()).select(key)
    return df.filter(F.col(count) != 0).join(trivial, key, "left_anti")
