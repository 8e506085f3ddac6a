"""Inputs of the registered queries: whole tables, and tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dirty_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with gaps, numbers as text, a constant, an empty column and repeated rows."""
    orders = table(spark, folder, "orders")
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    customer = F.col("o_custkey")
    rows = orders.select(
        F.col("o_orderkey").alias("Order Key"),
        F.when(priority != "4-NOT SPECIFIED", F.col("o_totalprice")).alias(" Total Value "),
        F.when(priority != "3-MEDIUM", status).alias("Status-Code"),
        F.when((priority == "5-LOW") & (status == "P"), "n/a")
        .when(customer >= 1000, F.format_number(customer, 0))
        .otherwise(F.concat(F.lit(" "), customer.cast("string"), F.lit(" ")))
        .alias("cust/text"),
        F.lit(1.0).alias("const"),
        F.lit(None).cast("double").alias("empty"),
        priority.alias("_p"),
        status.alias("_s"),
    )
    again = rows.filter((F.col("_p") == "1-URGENT") & (F.col("_s") == "P"))
    return rows.unionAll(again).drop("_p", "_s")


DIRTY_SQL = """
  SELECT o_orderkey AS "Order Key",
    CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_totalprice END AS " Total Value ",
    CASE WHEN o_orderpriority <> '3-MEDIUM' THEN o_orderstatus END AS "Status-Code",
    CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'n/a'
         WHEN o_custkey >= 1000 THEN format('{:,}', o_custkey)
         ELSE ' ' || o_custkey || ' ' END AS "cust/text",
    CAST(1.0 AS DOUBLE) AS const, CAST(NULL AS DOUBLE) AS empty
  FROM orders"""
DIRTY = f"""dirty AS ({DIRTY_SQL}
  UNION ALL {DIRTY_SQL} WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')"""

# The dirty table under its normalised names, texts converted: what follows the first cleaning steps.
TIDY = f"""{DIRTY}, tidy AS (
  SELECT "Order Key" AS order_key, " Total Value " AS total_value, "Status-Code" AS status_code,
    TRY_CAST(replace(trim("cust/text"), ',', '') AS DOUBLE) AS cust_text, const, empty FROM dirty)"""


def event_line(spark: SparkSession, folder: str) -> DataFrame:
    """Events with a target whose spread grows with the feature."""
    events = table(spark, folder, "events")
    return events.select(
        "event_id", F.col("user_id").alias("x"), (F.col("value") * (1 + F.col("user_id").cast("double") / 50)).alias("y")
    )


EVENT_LINE = "line AS (SELECT event_id, user_id AS x, value * (1 + CAST(user_id AS DOUBLE) / 50) AS y FROM events)"


def event_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Events with gaps in the feature and the target as text."""
    events = table(spark, folder, "events")
    kind = F.col("event_type")
    return events.select(
        "event_id",
        F.when(kind != "error", F.col("value")).alias("amount"),
        F.when(kind != "view", kind).alias("kind"),
        F.when(kind == "signup", F.lit("unknown")).otherwise(F.col("value").cast("decimal(18,2)").cast("string")).alias("score"),
    )


EVENT_GAPS = """gaps AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS amount,
  CASE WHEN event_type <> 'view' THEN event_type END AS kind,
  CASE WHEN event_type = 'signup' THEN 'unknown' ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS score FROM events)"""
