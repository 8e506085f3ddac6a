"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Labels the results carry.
NULL_LABEL = "空值"
UNKNOWN_FILL = "未知"
EMPTY_NAME = "column"

# What counts as a blank, a separator and a name character.
BLANKS = r"\s\x1c-\x1f"
SEPARATORS = BLANKS + r"\-/\\"
NAME_CHARS = r"\p{L}\p{N}"

# Fixed value: the texts that parse as a number.
NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))$"


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns in schema order; booleans are categories."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    """Every scalar column that is not numeric."""
    require_scalars(df)
    numeric = set(numeric_columns(df))
    return [c for c in df.columns if c not in numeric]


def require_scalars(df: DataFrame) -> None:
    """Refuse nested columns: they have no distinct values to count."""
    nested = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))
        or f.dataType.typeName() == "variant"
    ]
    if nested:
        raise ValueError(f"nested columns cannot be profiled, flatten or drop them: {nested}")


def col(name: str) -> Column:
    """A column by its exact name, dots, blanks and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_double(name: str) -> Column:
    """The column as a double, NaN read as missing."""
    return F.nanvl(col(name).cast("double"), F.lit(None).cast("double"))


def as_finite(name: str) -> Column:
    """The column as a double, NaN and the infinities read as missing."""
    value = as_double(name)
    return F.when(F.abs(value) < float("inf"), value)


def is_missing(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return col(name).isNull() | F.isnan(col(name))
    return col(name).isNull()


def stamp(value: Column) -> Column:
    """A time as the report shows it, without a time zone."""
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss")


KEY_BYTES = 16  # of an MD5


def text_key(value: Column) -> Column:
    """A key of at most 16 bytes that tells texts apart: up to 15 bytes the text itself, beyond that its MD5."""
    text = value.cast("string")
    return F.when(F.octet_length(text) < KEY_BYTES, text.cast("binary")).otherwise(F.unhex(F.md5(text.cast("binary"))))


def as_label(name: str) -> Column:
    """The value as text, missing shown as its own label."""
    return F.coalesce(col(name).cast("string"), F.lit(NULL_LABEL))


def rounded(value: Column, digits: int = 6) -> Column:
    """Round a result; a value that is not finite becomes null."""
    finite = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    return F.round(finite, digits)


def strip_blanks(value: Column) -> Column:
    return F.regexp_replace(value, rf"(?U)^[{BLANKS}]+|[{BLANKS}]+$", "")


def parse_number(value: Column) -> Column:
    """Text to double; blanks around it are ignored, anything else is null.

    The pattern keeps out what only the JVM would take for a number (``1d``).
    """
    text = strip_blanks(value)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def parse_grouped_number(value: Column) -> Column:
    """As :func:`parse_number`, after removing thousands commas."""
    return parse_number(F.replace(value, F.lit(","), F.lit("")))


def normalize_name_expr(value: Column) -> Column:
    """The column-name rule applied to data values: runs of letters and digits in lower case, joined by underscores.

    Separators and underscores end a run; any other character is left out of it.
    """
    kept = F.regexp_replace(F.lower(value), rf"(?U)[^{NAME_CHARS}{SEPARATORS}_]", "")
    joined = F.array_join(F.regexp_extract_all(kept, F.lit(f"[{NAME_CHARS}]+"), F.lit(0)), "_")
    return F.when(joined == "", EMPTY_NAME).otherwise(joined)


def normalize_names(names: Sequence[str]) -> list[str]:
    """The same rule for a schema; a name in use gets the next free number."""
    out: dict[str, None] = {}
    for name in names:
        runs = "".join(c if c.isalnum() else "_" if re.match(f"[{SEPARATORS}_]", c) else "" for c in str(name).lower())
        base = "_".join(filter(None, runs.split("_"))) or EMPTY_NAME
        numbered = (f"{base}_{i}" for i in itertools.count(2))
        out[next(n for n in itertools.chain([base], numbered) if n not in out)] = None
    return list(out)


def escape_cell(value: Column) -> Column:
    """Text made safe for one cell of a pipe table."""
    return F.replace(F.replace(value, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def safe_filename(value: Column) -> Column:
    """Last path component with runs of other characters as one underscore."""
    base = F.regexp_extract(F.regexp_replace(value, "/+$", ""), "([^/]*)$", 1)
    name = F.regexp_replace(base, rf"[^{NAME_CHARS}_.\-]+", "_")
    return F.when(name == "", "uploaded_data.csv").otherwise(name)


def file_suffix(value: Column) -> Column:
    """Lower-case text after the last dot of the last path component."""
    return F.lower(F.regexp_extract(value, r"\.([^./]+)$", 1))


# Where a report preview is cut.
PREVIEW_HEADING = "\n## 5. 回归诊断结果"
PREVIEW_LIMIT = 4000


def text_preview(
    value: Column, heading: str = PREVIEW_HEADING, limit: int = PREVIEW_LIMIT
) -> Column:
    """Text before ``heading`` if it lies within ``limit`` characters, else the first ``limit``."""
    at = F.locate(heading, value)  # 1-based, 0 when absent
    keep = F.when((at > 1) & (at - 1 <= limit), at - 1).otherwise(limit)
    return F.regexp_replace(F.substring(value, F.lit(1), keep), rf"(?U)[{BLANKS}]+$", "")


def limited_names(names: Column, limit: int = 12) -> Column:
    """The first names of an array as text, then how many are left out."""
    quoted = F.transform(F.slice(names, 1, limit), lambda n: F.concat(F.lit("`"), n, F.lit("`")))
    rest = F.size(names) - limit
    shown = F.array_join(quoted, ", ")
    return (
        F.when(F.size(names) == 0, "无")
        .when(rest > 0, F.concat(shown, F.lit("，另有 "), rest.cast("string"), F.lit(" 项未展开")))
        .otherwise(shown)
    )


def row_digest(keys: Sequence[str]) -> Column:
    """Hex digest of the key columns: the same on every run and partitioning."""
    parts = [F.coalesce(col(k).cast("string"), F.lit("")) for k in keys]
    return F.md5(parts[0] if len(parts) == 1 else F.concat_ws("|", *parts))


def digest_word(keys: Sequence[str], part: int = 0) -> Column:
    """One 32-bit part of the digest as a number."""
    return F.conv(F.substring(row_digest(keys), 8 * part + 1, 8), 16, 10).cast("bigint")
