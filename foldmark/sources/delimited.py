"""Delimited text: separator choice, localized numbers, submission and analysis sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldmark.functions.values import as_number, nan_to_null
from foldmark.session import small_side

# fixed values: separators in the order they are tried
SEPARATORS = (",", ";", "\t", "|", ":", " ")

# fixed values: encodings that the CSV reader and writer take themselves
NATIVE = {"utf8", "utf16", "utf16be", "utf16le", "utf32", "iso88591", "latin1", "usascii", "ascii"}


def _native(encoding: str) -> bool:
    return encoding.lower().replace("-", "").replace("_", "") in NATIVE


def _code_page(encoding: str) -> tuple[str, str]:
    """Upper halves of ISO-8859-1 and of another single-byte code page, character by character."""
    latin, other = [], []
    for byte in range(128, 256):
        try:
            char = bytes([byte]).decode(encoding)
        except UnicodeDecodeError:
            continue
        if len(char) != 1:
            raise ValueError(f"not a single-byte encoding: {encoding}")
        latin.append(chr(byte))
        other.append(char)
    return "".join(latin), "".join(other)


def _recode(df: DataFrame, source: str, target: str) -> DataFrame:
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    out = df.withColumns({c: F.translate(c, source, target) for c in texts})
    return out.toDF(*[c.translate(str.maketrans(source, target)) for c in out.columns])


def _marks(line: Column, sep: str) -> Column:
    """Separators in a line, not counting those inside quotes."""
    bare = F.regexp_replace(line, '"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit("")))


def choose_separator(spark: SparkSession, path: str, encoding: str | None = None) -> str:
    """First of ',' and ';' under which no line has more fields than the header, else a regular one.

    A separator the header does not hold reads the file as one column, and still wins if no line has
    one, as a plain reader would take it. One pass over the lines counts all separators.
    """
    schema = T.StructType([T.StructField("line", T.StringType())])
    charset = encoding if encoding and _native(encoding) else "iso-8859-1" if encoding else "utf-8"
    lines = spark.read.csv(path, schema=schema, sep="\u0001", quote="", encoding=charset)
    header = lines.limit(1).first()
    if header is None:
        return SEPARATORS[0]
    full = lines.filter(F.trim("line") != "")
    row = full.agg(
        *[F.max(_marks(F.col("line"), s)).alias(f"hi{i}") for i, s in enumerate(SEPARATORS)],
        *[F.min(_marks(F.col("line"), s)).alias(f"lo{i}") for i, s in enumerate(SEPARATORS)],
    ).first()
    heads = lines.limit(1).select(
        *[_marks(F.col("line"), s).alias(f"h{i}") for i, s in enumerate(SEPARATORS)]
    ).first()
    for i in (0, 1):
        if row[f"hi{i}"] <= heads[f"h{i}"]:
            return SEPARATORS[i]
    regular = [
        (heads[f"h{i}"], -i)
        for i in range(len(SEPARATORS))
        if heads[f"h{i}"] > 0 and row[f"hi{i}"] == row[f"lo{i}"]
    ]
    return SEPARATORS[-max(regular)[1]] if regular else SEPARATORS[0]


def read_csv_smart(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType | None = None,
    sep: str | None = None,
    encoding: str = "utf-8",
    decimal: str = ".",
    corrupt: str | None = None,
    **options,
) -> DataFrame:
    """Read a headed CSV; without ``sep`` it is chosen, without ``schema`` it is inferred.

    ``multiLine=True`` keeps line breaks inside quotes; it needs ``sep``, since lines are then no records.
    ``corrupt`` names a column that takes the text of records that do not fit the schema; their other cells stay.

    A single-byte code page is read as ISO-8859-1 and translated.
    With a decimal mark other than '.', numeric columns of the schema are read as text and converted;
    what is no number becomes NULL, and with ``corrupt`` the record's cells go there as they were read. NaN becomes NULL.
    """
    if not _native(encoding):
        page = _code_page(encoding)
        given = {"schema": schema, "sep": sep, "decimal": decimal, "corrupt": corrupt}
        return _recode(read_csv_smart(spark, path, encoding="iso-8859-1", **given, **options), *page)
    if options.get("multiLine") and not sep:
        raise ValueError("records of several lines need a separator")
    if corrupt and schema is None:
        raise ValueError("records can only fail a given schema")
    sep = sep or choose_separator(spark, path, encoding)
    reader = spark.read.options(header=True, sep=sep, encoding=encoding, escape='"', **options)
    if schema is None:
        return nan_to_null(reader.option("inferSchema", True).csv(path))
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if corrupt:
        wanted = T.StructType([*wanted.fields, T.StructField(corrupt, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    if decimal == ".":
        return nan_to_null(reader.schema(wanted).csv(path))
    loose = [f for f in wanted.fields if isinstance(f.dataType, (T.FractionalType, T.DecimalType))]
    names = {f.name for f in loose}
    text = T.StructType(
        [T.StructField(f.name, T.StringType() if f.name in names else f.dataType) for f in wanted.fields]
    )
    raw = reader.schema(text).csv(path)
    if corrupt:
        odd = F.lit(False)
        for f in loose:
            said = F.trim(f.name)
            odd |= said.isNotNull() & ~F.lower(said).isin("", "nan") & as_number(F.col(f.name), decimal).isNull()
        record = F.concat_ws(sep, *[F.coalesce(F.col(f.name).cast("string"), F.lit("")) for f in text.fields if f.name != corrupt])
        raw = raw.withColumn(corrupt, F.coalesce(F.col(corrupt), F.when(odd, record)))
    return raw.withColumns({f.name: as_number(F.col(f.name), decimal).cast(f.dataType) for f in loose})


def file_dialects(spark: SparkSession, path: str, fields: int | None = None) -> DataFrame:
    """``file``, ``sep`` and ``is_utf8`` of every file below a folder, by the rule of ``choose_separator`` for each by itself.

    With the number of ``fields``, the first separator comes before it that gives the header so many, and no line more.

    One aggregate over the lines: how many separators of each kind the header, the fullest and the emptiest line have, all of
    which merge, so files of any number and size are one job.
    """
    lines = _raw_lines(spark, path, header=False).withColumn("_at", F.monotonically_increasing_id())
    marks = F.array(*[_marks(F.col("line"), s) for s in SEPARATORS])
    full = F.trim("line") != ""
    each = lines.select("file", "_at", "_block", full.alias("_full"), marks.alias("_m"), F.is_valid_utf8(F.encode("line", "iso-8859-1")).alias("_u"))
    kinds = range(len(SEPARATORS))
    found = each.groupBy("file").agg(
        F.min_by("_m", F.struct("_block", "_at")).alias("head"), F.bool_and("_u").alias("is_utf8"),
        F.array(*[F.max(F.when(F.col("_full"), F.col("_m")[i])) for i in kinds]).alias("hi"), F.array(*[F.min(F.when(F.col("_full"), F.col("_m")[i])) for i in kinds]).alias("lo"),
    )
    fits = [F.col("hi")[i] <= F.col("head")[i] for i in kinds]
    sep = F.when(F.lit(False), SEPARATORS[0])
    for i in kinds if fields is not None else ():
        sep = sep.when(fits[i] & (F.col("head")[i] == fields - 1), SEPARATORS[i])
    sep = sep.when(fits[0], SEPARATORS[0]).when(fits[1], SEPARATORS[1])
    regular = F.array(*[F.when((F.col("head")[i] > 0) & (F.col("hi")[i] == F.col("lo")[i]), F.struct(F.col("head")[i].alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("sep"))) for i, s in enumerate(SEPARATORS)])
    best = F.array_max(F.array_compact(regular))["sep"]
    return found.select("file", sep.otherwise(F.coalesce(best, F.lit(SEPARATORS[0]))).alias("sep"), "is_utf8")


def _raw_lines(spark: SparkSession, path: str, header: bool) -> DataFrame:
    """Lines as ISO-8859-1, which keeps every byte, with their file; with ``header`` without the first of each file."""
    schema = T.StructType([T.StructField("line", T.StringType())])
    reader = spark.read.options(header=header, sep="\u0001", quote="", encoding="iso-8859-1", recursiveFileLookup=True)
    return reader.schema(schema).csv(path).select("line", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"))


def read_csv_folder(
    spark: SparkSession, path: str, schema: str | T.StructType, fallback: str = "windows-1252", corrupt: str | None = None, **options
) -> DataFrame:
    """Headed CSV files of any mix of separators and encodings below a folder, in one scan after that of ``file_dialects``.

    Files that are not UTF-8 are read in the single-byte code page ``fallback``. Columns come by position, with the path as ``file``;
    records are lines. ``corrupt`` names a column that takes the records that do not fit. NaN becomes NULL.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if corrupt:
        wanted = T.StructType([*wanted.fields, T.StructField(corrupt, T.StringType())])
        options["columnNameOfCorruptRecord"] = corrupt
    known = small_side(file_dialects(spark, path, len(wanted.fields) - bool(corrupt)).withColumnRenamed("file", "_file"))
    lines = _raw_lines(spark, path, header=True).filter(F.trim("line") != "").join(known, F.col("file") == F.col("_file"))
    as_utf8 = F.decode(F.encode("line", "iso-8859-1"), "utf-8")
    text = F.when(F.col("is_utf8"), as_utf8).otherwise(F.translate("line", *_code_page(fallback)))
    lines = lines.select("file", "sep", text.alias("line"))
    parsed = None
    for s in SEPARATORS:
        one = F.from_csv("line", _ddl(wanted), {**options, "sep": s, "escape": '"'})
        parsed = F.when(F.col("sep") == s, one) if parsed is None else parsed.when(F.col("sep") == s, one)
    return nan_to_null(lines.select("file", parsed.alias("r")).select("file", "r.*"))


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def write_csv(df: DataFrame, path: str, sep: str = ",", encoding: str = "utf-8") -> None:
    """CSV folder with a header per part, in any encoding the reader takes."""
    if not _native(encoding):
        latin, other = _code_page(encoding)
        df, encoding = _recode(df, other, latin), "iso-8859-1"
    df.write.options(header=True, sep=sep, encoding=encoding, escape='"').csv(path)


def write_submission(pred: DataFrame, path: str, key: str, prediction: str, names: Sequence[str] | None = None) -> None:
    """Id and prediction columns as a headed CSV, optionally renamed."""
    out = pred.select(key, prediction)
    write_csv(out.toDF(*names) if names else out, path)


def write_analysis(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Analysis rows as parquet, or as CSV with arrays and structs in JSON."""
    if form == "parquet":
        df.write.parquet(path)
        return
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
    write_csv(df.withColumns({c: F.to_json(c) for c in nested}), path)
