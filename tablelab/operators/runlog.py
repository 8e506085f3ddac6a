"""A run log as an append-only table: one row per state change, the newest row counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablelab.functions.columns import col
from tablelab.session import small_table

# States of a run, the changes that are allowed, and the progress of each stage.
ACTIVE = ("queued", "running")
DONE, DELETED = "completed", "deleted"
ALLOWED = (
    ("awaiting_confirmation", "queued"),
    ("queued", "queued"),
    ("queued", "running"),
    ("running", "running"),
    ("running", "completed"),
    ("running", "failed"),
    ("queued", "failed"),
    ("failed", "queued"),
)
STAGES = ((12, "cleaning"), (32, "eda"), (58, "ols"), (72, "models"), (82, "report"))
RECENT = 20
PARTS = 256  # an id with more than this share of the rows is cut
GROUP = 16  # cuts that are compared at once

RUN_LOG = "id string, status string, progress int, stage string, payload string, updated_at timestamp"


def latest_state(log: DataFrame, id: str, at: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The newest row of every id, or only its ``columns``; rows are compared before the shuffle, so a busy id costs one row per task."""
    rest = [c for c in (log.columns if columns is None else columns) if c != id]
    newest = F.max_by(F.struct(*[col(c) for c in rest]), F.struct(*[col(c) for c in at]))
    return log.groupBy(col(id)).agg(newest.alias("_s")).select(col(id), "_s.*")


def recent_runs(log: DataFrame, id: str, at: Sequence[str], rows: int = RECENT) -> DataFrame:
    """The newest state of the ids that were created last.

    The ids are chosen by their times alone; whole rows are compared for these
    few ids only, which are as many as the list is long.
    """
    rest = [c for c in log.columns if c != id]
    when = F.struct(*[col(c) for c in at])
    created = log.groupBy(col(id).alias("_id")).agg(F.min(col(at[0])).alias("created_at"))
    chosen = F.broadcast(created.orderBy(F.col("created_at").desc(), "_id").limit(rows))
    states = log.join(chosen, col(id).eqNullSafe(F.col("_id"))).groupBy(col(id), "created_at")
    newest = states.agg(F.max_by(F.struct(*[col(c) for c in rest]), when).alias("_s"))
    return newest.orderBy(F.col("created_at").desc(), col(id)).select(col(id), "created_at", "_s.*")


def drop_runs(log: DataFrame, deletions: DataFrame, id: str, status: str | None = None, at: Sequence[str] = ()) -> DataFrame:
    """The log without the deleted ids.

    An unknown id is an error. With ``status`` given, so is an id that is
    queued or running.
    """
    wanted = deletions.select(col(id)).distinct()
    if not wanted.join(log.select(col(id)).distinct(), id, "left_anti").isEmpty():
        raise KeyError("deletion of an unknown run")
    if status is not None:
        states = latest_state(log, id, at, [status])
        if not states.filter(col(status).isin(*ACTIVE)).join(wanted, id, "left_semi").isEmpty():
            raise ValueError("deletion of a run that is queued or running")
    return log.join(wanted, id, "left_anti")


def status_counts(states: DataFrame, status: str, active: Sequence[str] = ACTIVE, done: str = DONE) -> DataFrame:
    """Runs in all, active ones and finished ones."""
    return states.agg(
        F.count("*").alias("total"),
        F.count_if(col(status).isin(*active)).alias("active"),
        F.count_if(col(status) == done).alias("completed"),
    )


def _micros(log: DataFrame, name: str) -> Column:
    """Microseconds, without a time zone in the way for zoneless timestamps."""
    t = col(name)
    if isinstance(log.schema[name].dataType, T.TimestampType):
        return F.unix_micros(t)
    minutes = F.unix_date(F.to_date(t)).cast("bigint") * 1440 + F.hour(t) * 60 + F.minute(t)
    return minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), t) * 1_000_000).cast("bigint")


def _stretches(rows: DataFrame) -> DataFrame:
    """``rows`` with ``part``, the stretch of its id's history that a row lies in.

    Only an id with more than one in ``PARTS`` of all rows is cut, at approximate
    quantiles of its own times. Such ids are fewer than ``PARTS``, so that all
    cuts together are at most the square of that number. Rows of one id and one
    microsecond stay together.
    """
    busy = F.broadcast(  # fewer than PARTS rows
        rows.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") > F.lit(rows.count() / PARTS)).select(F.col("id").alias("_id"))
    )
    cut = F.percentile_approx("micros", [k / PARTS for k in range(1, PARTS)], 100 * PARTS)
    cuts = rows.join(busy, F.col("id").eqNullSafe(F.col("_id")), "left_semi").groupBy(F.col("id").alias("_id")).agg(
        F.array_distinct(cut).alias("cuts")
    )
    # Every GROUP-th cut first, then the cuts up to the next of these.
    cuts = cuts.withColumn("firsts", F.filter("cuts", lambda c, i: i % GROUP == 0))
    placed = rows.join(F.broadcast(cuts), F.col("id").eqNullSafe(F.col("_id")), "left")

    def reached(some: Column) -> Column:
        return F.size(F.filter(some, lambda c: c <= F.col("micros")))

    group = F.greatest(reached(F.col("firsts")) - 1, F.lit(0))
    placed = placed.withColumn("group", F.when(F.col("micros").isNotNull(), group))
    part = F.col("group") * GROUP + reached(F.slice("cuts", F.col("group") * GROUP + 1, F.lit(GROUP)))
    return placed.withColumn("part", F.coalesce(F.when(F.col("cuts").isNotNull(), part), F.lit(0))).drop("_id", "cuts", "firsts", "group")


def invalid_transitions(
    log: DataFrame, id: str, at: Sequence[str], status: str, allowed: Sequence[tuple[str, str]] = ALLOWED
) -> DataFrame:
    """State changes of an id that the list of allowed pairs does not hold.

    The history of a busy id is cut into stretches of about equally many rows
    that are compared apart, so that it spreads over many tasks. The changes
    across the cuts come from the first and last row of each stretch.
    """
    rows = _stretches(
        log.select(
            col(id).alias("id"),
            _micros(log, at[0]).alias("micros"),
            F.struct(*[col(c) for c in at]).alias("at"),
            col(status).alias("status"),
        )
    )
    inside = Window.partitionBy("id", "part").orderBy("at")
    steps = rows.select("id", "at", F.lag("status").over(inside).alias("before"), "status").filter("before is not null")
    ends = rows.groupBy("id", "part").agg(
        F.min_by("status", "at").alias("status"), F.max_by("status", "at").alias("last"), F.min("at").alias("at")
    )
    across = Window.partitionBy("id").orderBy("part")  # at most PARTS rows per id
    cuts = ends.select("id", "at", F.lag("last").over(across).alias("before"), "status").filter("before is not null")
    fine = F.struct("before", "status").isin(*[F.struct(F.lit(a).alias("before"), F.lit(b).alias("status")) for a, b in allowed])
    bad = steps.unionByName(cuts).filter(~fine)
    return bad.select(F.col("id").alias(id), "at.*", F.col("before").alias("from_status"), F.col("status").alias("to_status"))


def stage_reached(progress: Column) -> Column:
    """The number of stages a progress value has reached."""
    return sum((F.when(progress >= at, 1).otherwise(0) for at, _ in STAGES), F.lit(0))


def stage_name(progress: Column) -> Column:
    """The last stage a progress value has reached."""
    out = F.lit("waiting")
    for at, name in STAGES:
        out = F.when(progress >= at, name).otherwise(out)
    return out


class RunLog:
    """Appends state changes to a table and reads the newest ones."""

    def __init__(self, spark, path: str) -> None:
        self.spark, self.path = spark, path

    def append(self, id: str, status: str, progress: int, stage: str, payload: str = "{}") -> None:
        row = small_table(self.spark, [(id, status, progress, stage, payload)], RUN_LOG.rsplit(",", 1)[0])
        row.withColumn("updated_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(RUN_LOG).parquet(self.path)

    def states(self) -> DataFrame:
        """The newest state of each run that is not deleted, and when it was created."""
        log = self.read()
        newest = latest_state(log, "id", ["updated_at", "progress"]).filter(col("status") != DELETED)
        return newest.join(log.groupBy("id").agg(F.min("updated_at").alias("created_at")), "id")

    def delete(self, id: str) -> None:
        """Mark a run as deleted, for good. Unknown and active runs are refused, as in :func:`drop_runs`."""
        drop_runs(self.states(), small_table(self.spark, [(id,)], "id string"), "id", "status", ["updated_at"])
        self.append(id, DELETED, 100, DELETED)
