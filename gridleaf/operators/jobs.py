"""Job and task tables: roll-ups, history, attempts and isolated runs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

# --- fixed values ---------------------------------------------------------
DONE = ("succeeded", "skipped")
TERMINAL = ("succeeded", "skipped", "failed", "cancelled")
ACTIVE = ("queued", "running", "paused")
VIEWS = {"running": ("running", "queued"), "failed": ("failed",), "done": ("succeeded", "skipped")}
PAGE_LIMIT = (1, 500)
# --------------------------------------------------------------------------


def task_filter(tasks: DataFrame, view: str = "all") -> DataFrame:
    return tasks.where(F.col("status").isin(*VIEWS[view])) if view in VIEWS else tasks


def job_rollup(tasks: DataFrame) -> DataFrame:
    """Counts and progress per job; a finished task counts as 100."""
    status = F.col("status")
    share = F.when(status.isin(*TERMINAL), 100.0).otherwise(F.col("progress"))
    return tasks.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(status.isin(*DONE)).alias("completed"),
        F.count_if(status == "failed").alias("failed"), F.count_if(status == "cancelled").alias("cancelled"),
        F.round(F.avg(share), 1).alias("progress"),
    )


def job_status(rollup: DataFrame, cancelled: Column) -> DataFrame:
    """Adds ``status`` and ``error``. A job of skipped files succeeds; ``strict_success`` is the guard."""
    none_done = (F.col("failed") > 0) & (F.col("completed") == 0)
    status = F.when(cancelled, "cancelled").when(none_done, "failed").otherwise("succeeded")
    error = F.when(cancelled, None).when(none_done, "all files failed").when(
        F.col("failed") > 0, F.concat(F.col("failed").cast("string"), F.lit(" files failed"))
    )
    return rollup.withColumns({"status": status, "error": error})


def strict_success(tasks: DataFrame) -> DataFrame:
    """A job passes only when every task succeeded."""
    good = F.col("status") == "succeeded"
    return tasks.groupBy("job_id").agg(F.bool_and(good).alias("passed"), F.count_if(~good).alias("bad_tasks"))


def failure_reasons(tasks: DataFrame) -> DataFrame:
    """One row per task that did not succeed, with its reason."""
    reason = F.concat("file_name", F.lit("("), "status", F.lit(": "), F.coalesce("error", F.lit("no message")), F.lit(")"))
    return tasks.where(F.col("status") != "succeeded").select("job_id", "task_id", reason.alias("reason"))


def active_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin(*ACTIVE))


def list_jobs(jobs: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the history, newest first."""
    limit = max(PAGE_LIMIT[0], min(PAGE_LIMIT[1], limit))
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).offset(max(0, offset)).limit(limit)


def job_tasks(tasks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Tasks of the given jobs in input order."""
    return tasks.join(jobs.select("job_id"), "job_id", "left_semi").orderBy("job_id", "seq")


def clear_history(jobs: DataFrame, tasks: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs and tasks that remain; tasks go with their job."""
    ids = deleted.select("job_id").distinct()
    return jobs.join(ids, "job_id", "left_anti"), tasks.join(ids, "job_id", "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, updated: list[str], order: str | None = None) -> DataFrame:
    """Insert, or replace the listed columns of a known key; the other columns keep their first value.

    ``new`` may hold a key several times: its rows are taken in the order of column ``order`` (of ``new``; without one,
    of all its columns), as if written one after the other. Each key comes out once.
    """
    rest = [c for c in old.columns if c != key]
    at = F.struct(*([order] if order else []), *sorted(c for c in new.columns if c != order))
    new = new.groupBy(key).agg(*[(F.max_by if c in updated else F.min_by)(F.struct(c), at)[c].alias(c) for c in rest])
    a = old.select(key, *[F.col(c).alias(f"__o_{c}") for c in rest], F.lit(True).alias("__old"))
    b = new.select(key, *[F.col(c).alias(f"__n_{c}") for c in rest], F.lit(True).alias("__new"))
    both = a.join(b, key, "full_outer")

    def pick(name: str) -> Column:
        o, n = F.col(f"__o_{name}"), F.col(f"__n_{name}")
        fresh = F.col("__new").isNotNull() if name in updated else F.col("__old").isNull()
        return F.when(fresh, n).otherwise(o).alias(name)

    return both.select(*[F.col(key) if c == key else pick(c) for c in old.columns])


def size_change(tasks: DataFrame) -> DataFrame:
    """Bytes before and after per job, and the share saved in percent."""
    before, after = F.sum("bytes_in"), F.sum("bytes_out")
    return tasks.groupBy("job_id").agg(
        before.alias("bytes_in"), after.alias("bytes_out"),
        F.when(before > 0, F.round((1 - after / before) * 100, 4)).otherwise(0.0).alias("saved_percent"),
    )


def first_success(attempts: DataFrame) -> DataFrame:
    """Per file the first engine that worked, notes of the earlier failures, or the last error.

    A file has one attempt per engine, so the notes are a handful.
    """
    ok = F.col("ok")
    hit = F.min(F.when(ok, F.col("ord")))
    tried = F.array_sort(F.collect_list(F.when(~ok, F.struct("ord", "engine", "error"))))
    done = attempts.groupBy("file_id").agg(
        hit.alias("__hit"), F.min_by(F.when(ok, F.col("engine")), F.when(ok, F.col("ord"))).alias("engine"),
        F.max_by(F.when(~ok, F.col("error")), F.when(~ok, F.col("ord"))).alias("__last"),
        F.max("ord").alias("__max"), tried.alias("__tried"),
    )
    before = F.filter(
        "__tried", lambda t: F.when(F.col("__hit").isNotNull(), t["ord"] < F.col("__hit")).otherwise(t["ord"] < F.col("__max"))
    )
    notes = F.array_join(F.transform(before, lambda t: F.concat(t["engine"], F.lit(" failed ("), t["error"], F.lit(")"))), "; ")
    return done.select("file_id", "engine", notes.alias("notes"), F.when(F.col("__hit").isNull(), F.col("__last")).alias("error"))


def preferred_engine(engines: DataFrame) -> DataFrame:
    """Per domain the available engine of the highest fidelity; the first of equals."""
    rank = F.struct(F.col("fidelity").alias("f"), (-F.col("ord")).alias("o"))
    return engines.where("available").groupBy("domain").agg(
        F.max_by("engine", rank).alias("engine"), F.max("fidelity").alias("fidelity")
    )


def run_isolated(rows: DataFrame, work: Callable[[dict], str], result: str = "result") -> DataFrame:
    """Run Python per row so that a bad row fails alone.

    Adds ``result, status, error, duration_ms``. For code that native ``try_*`` expressions cannot
    replace; rows travel in Arrow batches.
    """
    schema = StructType(
        rows.schema.fields
        + [StructField(result, StringType()), StructField("status", StringType()), StructField("error", StringType()), StructField("duration_ms", DoubleType())]
    )

    def values_of(column: pa.Array) -> list:  # inside, so that it travels to the workers by value
        """``column.to_pylist()``; whole numbers and texts go through numpy, which takes a tenth of the time."""
        kind = column.type
        if pa.types.is_string(kind) or pa.types.is_large_string(kind) or (pa.types.is_integer(kind) and not column.null_count):
            return column.to_numpy(zero_copy_only=False).tolist()
        return column.to_pylist()

    def outcomes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clock = time.monotonic
        for batch in batches:
            if not batch.num_rows:
                continue
            names, got, errors, took = batch.schema.names, [], [], []
            for values in zip(*map(values_of, batch.columns)):
                record = dict(zip(names, values))
                start = clock()
                try:
                    out, error = work(record), None
                except Exception as problem:  # a row must never take its batch with it
                    out, error = None, f"{type(problem).__name__}: {problem}"
                took.append((clock() - start) * 1000)
                got.append(out)
                errors.append(error)
            text = pa.array(errors, pa.string())
            status = pc.if_else(text.is_null(), "succeeded", "failed")
            # the columns of the row pass as they are
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string()), status, text, pa.array(took, pa.float64())], names=schema.names)

    return rows.mapInArrow(outcomes_of, schema)
