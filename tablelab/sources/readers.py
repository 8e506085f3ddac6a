"""Files to DataFrames: CSV of unknown encoding, JSON of either layout, columnar files."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablelab.functions.columns import col, parse_number

# Encodings tried, in order.
ENCODINGS = ("UTF-8", "GBK")
# Texts of a CSV field that mean a missing value.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)


def is_valid(lines: DataFrame, encoding: str) -> bool:
    """Whether every line decodes. All of the text is looked at, on the executors."""
    if encoding == "UTF-8":
        bad = ~F.is_valid_utf8("value")
    else:
        bad = F.col("value").isNotNull() & F.decode(F.col("value").cast("binary"), encoding).contains("�")
    return lines.filter(bad).isEmpty()


def csv_encoding(spark: SparkSession, path: str) -> str:
    lines = spark.read.text(path)
    if is_valid(lines, "UTF-8"):
        return "UTF-8"
    allow_charsets(spark)
    if is_valid(lines, "GBK"):
        return "GBK"
    raise ValueError(f"{path} is neither UTF-8 nor GBK")


def allow_charsets(spark: SparkSession) -> None:
    """Let Spark use the JVM's character sets; bad bytes then read as U+FFFD."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    spark.conf.set("spark.sql.legacy.codingErrorAction", "true")


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, encoding: str | None = None, multi_line: bool = False
) -> DataFrame:
    """CSV with a header. Give ``schema`` and ``encoding`` to save a pass over the file for each.

    Texts that mean a missing value are null, and types are chosen without them.
    A record with more or fewer fields than the header is an error when it is
    read. Of equal header names (case aside, as in Spark) the later ones are
    numbered. ``multi_line`` allows line breaks inside quotes; such a file cannot
    be split.
    """
    encoding = encoding or csv_encoding(spark, path)
    if encoding.upper() == "GBK":
        allow_charsets(spark)
    reader = spark.read.option("encoding", encoding).option("escape", '"').option("multiLine", multi_line)
    strict = reader.option("header", True).option("mode", "FAILFAST")
    if schema is not None:
        return strict.schema(schema).csv(path)
    df = strict.option("ignoreLeadingWhiteSpace", False).csv(path)
    head = reader.option("header", False).csv(path).first()
    if head is not None and len({str(n).lower() for n in head}) < len(head):
        df = df.toDF(*_numbered([str(n or "").removeprefix("\ufeff") for n in head]))
    return _typed(df)


def _numbered(names: list[str]) -> list[str]:
    out: list[str] = []
    taken: set[str] = set()
    for name in names:
        new, i = name, 0
        while new.lower() in taken:
            i += 1
            new = f"{name}.{i}"
        taken.add(new.lower())
        out.append(new)
    return out


def _typed(df: DataFrame) -> DataFrame:
    """Text columns as the narrowest type that holds all their values: whole number, number, boolean, date, time stamp or text."""

    def kinds(c: Column) -> dict[str, Column]:
        bare = F.trim(c)
        return {
            "int": F.when(bare.rlike(r"^[+-]?\d{1,10}$"), bare.try_cast("int")),
            "bigint": F.when(bare.rlike(r"^[+-]?\d{1,19}$"), bare.try_cast("bigint")),
            "double": parse_number(c),
            "boolean": F.when(F.lower(bare).isin("true", "false"), bare.try_cast("boolean")),
            "date": F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}$"), bare.try_cast("date")),
            "timestamp": F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}[ T]"), bare.try_cast("timestamp")),
        }

    cells = {c: F.when(~col(c).isin(*MISSING), col(c)) for c in df.columns}
    tests = {c: {kind: value for kind, value in kinds(cell).items()} for c, cell in cells.items()}
    counts = [F.count(cells[c]) for c in cells] + [F.count(v) for c in cells for v in tests[c].values()]
    found = list(df.agg(*counts).first())
    out, at = [], len(cells)
    for i, (c, cell) in enumerate(cells.items()):
        fits = [v for v, n in zip(tests[c].values(), found[at:]) if found[i] and n == found[i]]
        at += len(tests[c])
        out.append((fits[0] if fits else cell).alias(c))
    return df.select(*out)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A JSON array or JSON lines, told apart by the first character that is not blank. A broken record is an error."""
    head = spark.read.text(path).select(F.ltrim(F.regexp_replace("value", "^[﻿\\s]+", "")).alias("v")).filter("v <> ''").first()
    array = head is not None and head["v"].startswith("[")
    reader = spark.read.option("multiLine", array).option("mode", "FAILFAST")
    if schema is not None:
        return reader.schema(schema).json(path)
    try:
        df = reader.json(path)
    except Exception as error:
        raise ValueError(f"{path} holds neither an array of records nor one record per line") from error
    # Spark sorts the fields; the first record has them in the order of the file.
    text = spark.read.text(path, wholetext=array).filter("trim(value) <> ''")
    plain = F.regexp_replace("value", "^[\ufeff\\s]+", "")
    first = F.get_json_object(plain, "$[0]") if array else plain
    keys = text.select(F.json_object_keys(first).alias("k")).first()
    order = [k for k in dict.fromkeys((keys and keys["k"]) or []) if k in df.columns]
    return df.select(*[col(c) for c in [*order, *(c for c in df.columns if c not in order)]])


READERS = {
    ".csv": read_csv,
    ".json": read_json,
    ".parquet": lambda spark, path, schema=None: (spark.read.schema(schema) if schema else spark.read).parquet(path),
}


def read_table(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """A table by file suffix, or by ``fmt`` for folders without one."""
    suffix = f".{fmt.lower()}" if fmt else PurePosixPath(path).suffix.lower()
    if suffix not in READERS:
        raise ValueError(f"unsupported file format: {suffix or path}")
    return flatten(READERS[suffix](spark, path, **options))


def flatten(df: DataFrame) -> DataFrame:
    """Struct columns replaced by their fields, named ``outer.inner``."""
    while any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
        out = []
        for f in df.schema.fields:
            name = "`" + f.name.replace("`", "``") + "`"
            if isinstance(f.dataType, T.StructType):
                out += [F.col(name).getField(g).alias(f"{f.name}.{g}") for g in f.dataType.names]
            else:
                out.append(F.col(name))
        df = df.select(*out)
    return df
