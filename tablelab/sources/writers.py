"""Result tables and summaries to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

BOM = "﻿"
SCHEMAS = "schemas"


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """A folder of part files. Every CSV part has a header and starts with a byte-order mark."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        marked = df.toDF(BOM + df.columns[0], *df.columns[1:])
        marked.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    elif fmt in ("parquet", "json"):
        writer.format(fmt).save(path)
    else:
        raise ValueError(f"unsupported output format: {fmt}")


def write_summary(parts: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Result tables of a few rows as one JSON record with an array per table, and their schemas."""
    if SCHEMAS in parts:
        raise ValueError(f"a table cannot be called {SCHEMAS}")
    out = None
    for name, df in parts.items():
        rows = df.agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias(name)).withColumn("_", F.lit(0))
        out = rows if out is None else out.join(rows, "_")
    ddl = [F.lit(x) for name, df in parts.items() for x in (name, df.schema.toDDL())]
    out = out.drop("_").withColumn(SCHEMAS, F.create_map(*ddl))
    out.coalesce(1).write.mode(mode).option("ignoreNullFields", False).json(path)


def read_summary(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that :func:`write_summary` has written, with their types; rows keep their order."""
    kinds = spark.read.schema(f"{SCHEMAS} map<string,string>").json(path).first()[0]
    fields = [T.StructField(name, T.ArrayType(T.StructType.fromDDL(ddl))) for name, ddl in kinds.items()]
    record = spark.read.schema(T.StructType(fields)).json(path)
    return {name: record.select(F.inline(F.col(f"`{name}`"))) for name in kinds}
