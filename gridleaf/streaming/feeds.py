"""Streams: task events, throttling, log tail and folder watching. Each has a batch twin."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.files import extension, file_name
from ..operators.scan import null_safe_join
from ..sources.inventory import list_folder

# --- fixed values ---------------------------------------------------------
THROTTLE_MS = 80
LOG_LINES = 500
TASK_SECONDS = 600
# --------------------------------------------------------------------------

BUCKET_MS = 600_000


def latest_task_state(events: DataFrame, key: str = "task_id") -> DataFrame:
    """Last event per key. The same expression runs on a stream in update mode."""
    rest = [c for c in events.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct("ts", "seq"))
    return events.groupBy(key).agg(last.alias("__last")).select(key, *[F.col(f"__last.{c}").alias(c) for c in rest])


def log_tail(log: DataFrame, n: int = LOG_LINES) -> DataFrame:
    """The newest ``n`` lines (the feature is the limit)."""
    return log.orderBy(F.desc("seq")).limit(n)


def throttle(events: DataFrame, interval_ms: int = THROTTLE_MS) -> DataFrame:
    """Per task, drop an event closer than ``interval_ms`` to the last kept one; forced ones always stay.

    ``task_id, ts_ms, seq, forced`` plus anything. What is kept depends on the last kept event, which no window can
    tell, and a run of close events may hold a third of all rows. So time is cut in cells: each cell is reduced, on its
    own, to a step function from the last kept time before it to the last one in it (at most one step a millisecond of
    the interval), a task's functions are put one after another, and then each cell is read once from its known start.
    Of events at one time only the first by ``seq`` can stay unforced, so a cell has a row a millisecond at most,
    however many events there are. Null ``forced`` counts as false; events without a time stay.
    """
    if interval_ms <= 0:
        return events
    forced = F.coalesce("forced", F.lit(False))
    timed = events.where(F.col("ts_ms").isNotNull()).select(
        "task_id", F.floor(F.col("ts_ms") / BUCKET_MS).alias("__b"), F.col("ts_ms").cast("bigint").alias("__at"), forced.alias("__forced"),
        F.struct(F.col("seq"), ~forced).alias("__order"), F.struct(*events.columns).alias("__row"),
    )
    spot = ["task_id", "__b", "__at"]
    any_forced = F.bool_or("__forced").alias("__forced")
    times = timed.groupBy(*spot).agg(any_forced).repartition("task_id", "__b").sortWithinPartitions(*spot)
    task = f"task_id {timed.schema['task_id'].dataType.simpleString()}, __b bigint"
    steps = times.mapInArrow(_cell_steps(interval_ms, BUCKET_MS), f"{task}, bounds array<bigint>, exits array<bigint>, forced boolean")
    carried = steps.repartition("task_id").sortWithinPartitions("task_id", "__b").mapInArrow(_follow(interval_ms), f"{task}, __last bigint")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            chosen = []
            for at, certain, start in zip(*(batch.column(c).to_pylist() for c in ("__at", "__forced", "__last"))):
                if at is None:  # a cell begins
                    last = start
                    chosen.append(False)
                    continue
                chosen.append(last is None or at - last >= interval_ms)
                last = at if chosen[-1] or certain else last
            yield batch.select(["__row"]).filter(pa.array(chosen, pa.bool_()))

    first = timed.groupBy(*spot).agg(any_forced, F.min_by("__row", "__order").alias("__row"))
    cells = first.unionByName(carried, allowMissingColumns=True).repartition("task_id", "__b").sortWithinPartitions(*spot)
    kept = cells.select("__row", "__at", "__forced", "__last").mapInArrow(keep, first.select("__row").schema).select("__row.*")
    return events.where(forced | F.col("ts_ms").isNull()).unionByName(kept.where(~forced))


def _cell_steps(interval: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row per cell: ``bounds`` and ``exits`` of its step function, and whether a forced time ends the bounds."""

    def steps(cell: int, times: np.ndarray, forced: np.ndarray) -> tuple[list[int], list[int], bool]:
        here, sure = np.arange(len(times)), np.flatnonzero(forced)
        close = np.searchsorted(times, times + interval)
        ahead = np.minimum(close, np.append(sure, len(times))[np.searchsorted(sure, here, "right")])
        end = np.where(ahead < len(times), ahead, here)
        while (end != end[end]).any():  # successors of successors: log rounds
            end = end[end]
        # No time kept before the cell can pass over the first forced one, or one a whole interval inside.
        stop = min(int(np.searchsorted(times, cell * width + interval - 1)), int(sure[0]) if len(sure) else len(times), len(times) - 1)
        exits = times[end[: stop + 1]]
        step = np.append(exits[1:] != exits[:-1], True)
        return times[: stop + 1][step].tolist(), exits[step].tolist(), bool(forced[stop])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, times, flags = None, [], []
        for batch in batches:
            done = []
            tasks, cells, at, forced = (column.to_pylist() for column in batch.columns)
            for row in zip(tasks, cells, at, forced):
                if key != row[:2]:
                    done += [(*key, *steps(key[1], np.array(times), np.array(flags)))] if key else []
                    key, times, flags = row[:2], [], []
                times.append(row[2])
                flags.append(row[3])
            kind = batch.schema.field(0).type
            yield _step_rows(done, kind)
        if key:
            yield _step_rows([(*key, *steps(key[1], np.array(times), np.array(flags)))], kind)

    return run


def _step_rows(rows: list[tuple], task: pa.DataType) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    fields = [("task_id", task), ("__b", pa.int64()), ("bounds", longs), ("exits", longs), ("forced", pa.bool_())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def _follow(interval: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The last time kept before each cell; a task's cells come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, task, last = False, None, None
        for batch in batches:
            before = []
            for key, bounds, exits, forced in zip(*(batch.column(c).to_pylist() for c in ("task_id", "bounds", "exits", "forced"))):
                if not begun or key != task:
                    begun, task, last = True, key, None
                before.append(last)
                step = 0 if last is None else bisect_left(bounds, last + interval)
                if step < len(bounds) or forced:
                    last = exits[min(step, len(bounds) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(before, pa.int64())], ["task_id", "__b", "__last"])

    return run


def throttle_stream(events: DataFrame, interval_ms: int = THROTTLE_MS) -> DataFrame:
    """The same on a stream with an event time ``ts``; a task's state goes after its longest run time.

    Forced events go past the watermark and always stay, however late; the others are judged by the state, which counts
    the forced ones too.
    """
    # whole numbers beside nulls would be rounded in pandas, so all but the times travel as text
    whole = [c for c, kind in events.dtypes if kind in ("bigint", "int", "smallint", "tinyint") and c not in ("ts_ms", "seq")]
    told = events.withColumns({c: F.col(c).cast("string") for c in whole}) if whole else events
    names = told.columns

    def keep(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last_kept = state.get[0] if state.exists else None
        batch = pd.concat(list(frames)).sort_values(["ts_ms", "seq"], kind="stable")
        chosen = []
        for at, forced in zip(batch["ts_ms"], batch["forced"]):
            hit = bool(forced) or last_kept is None or at - last_kept >= interval_ms
            chosen.append(hit and not forced)
            last_kept = int(at) if hit else last_kept
        state.update((last_kept,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(batch["ts_ms"].max())) + TASK_SECONDS * 1000)
        yield batch.loc[chosen, names]

    judged = (
        told.withWatermark("ts", f"{TASK_SECONDS} seconds")
        .groupBy("task_id")
        .applyInPandasWithState(keep, told.schema, "last_kept bigint", "append", "EventTimeTimeout")
    )
    types = dict(events.dtypes)
    back = judged.withColumns({c: F.col(c).cast(types[c]) for c in whole}) if whole else judged
    return back.unionByName(events.where("forced"))


Batch = Callable[[DataFrame, int], None]


def fresh_files(found: DataFrame, known: DataFrame) -> DataFrame:
    """The files of a listing that are new or rewritten: no known one has their path, size and time."""
    spot = ["path", "length", "modificationTime"]
    return found.join(known.select(*spot).hint("merge"), spot, "left_anti")


def watch_tick(spark: SparkSession, root: str, out: str, seen: str, exts: list[str], work: Batch, tick: int) -> int:
    """One look at the folder: hand the files not seen yet to ``work`` as one batch, then note them.

    A file is known by path, size and time, so a rewritten one counts as new. Results below ``out``
    are left out. Files are noted only after ``work`` returns: a lost run is repeated, never skipped.
    """
    prefix = "file:" + out if out.startswith("/") else out
    found = list_folder(spark, root).where(
        ~F.col("path").startswith(prefix.rstrip("/") + "/") & extension(file_name(F.col("path"))).isin(*exts)
    )
    schema = "path string, length bigint, modificationTime timestamp"
    known = spark.read.schema(schema).parquet(seen) if _exists(spark, seen) else spark.createDataFrame([], schema)
    fresh = fresh_files(found, known)
    # Written first: the listing must not change between the work and the note.
    pending = f"{seen.rstrip('/')}_pending/{tick}"
    fresh.write.mode("overwrite").parquet(pending)
    batch = spark.read.schema(schema).parquet(pending)
    n = batch.count()
    if n:
        work(batch, tick)
        batch.write.mode("append").parquet(seen)
    return n


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def watch_folder(spark: SparkSession, root: str, out: str, state: str, exts: list[str], work: Batch, seconds: float = 2.0) -> StreamingQuery:
    """Look at a folder every few seconds until the query is stopped.

    Spark's file source remembers paths and would miss rewritten files, hence a clock stream whose
    batches list the folder. ``work`` gets each batch whole (one task of an aggregate action).
    """
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def tick(_: DataFrame, number: int) -> None:
        watch_tick(spark, root, out, f"{state}/seen", exts, work, number)

    return (
        clock.writeStream.foreachBatch(tick).trigger(processingTime=f"{seconds} seconds")
        .option("checkpointLocation", f"{state}/clock").start()
    )


def new_files(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """Arriving files as a stream, for folders whose files are never rewritten."""
    reader = spark.readStream.format("binaryFile").schema(
        "path string, modificationTime timestamp, length bigint, content binary"
    ).option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(root).select("path", "length", "modificationTime")


def batch_merges(docs: DataFrame, sink: Batch, checkpoint: str) -> StreamingQuery:
    """Every arriving batch of documents is one merge; files seen before are never merged again."""
    from ..operators.pages import merge_bookmarks

    def merge(batch: DataFrame, number: int) -> None:
        sink(merge_bookmarks(batch.withColumn("merge_id", F.lit(str(number)))), number)

    return docs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tail_stream(log: DataFrame, path: str, checkpoint: str, n: int = LOG_LINES) -> StreamingQuery:
    """Keep the newest lines of a log stream in versioned folders below ``path``."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/{number - 1}"
        both = batch.unionByName(spark.read.schema(batch.schema).parquet(before)) if _exists(spark, before) else batch
        log_tail(both, n).write.mode("overwrite").parquet(f"{path}/{number}")

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
