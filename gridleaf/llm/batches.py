"""Row streams over Arrow batches, shared by the operators that run Python inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..session import ship

#: Rows and bytes after which a result batch is handed on.
ROWS, BYTES = 4096, 8 << 20


def read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows one at a time; only one value of each column is a Python object at any moment."""
    for batch in batches:
        columns = batch.columns
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def write(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size out of rows."""
    kept: list[tuple] = []
    held = 0
    for row in rows:
        kept.append(row)
        held += sum(len(v) for v in row if isinstance(v, (str, bytes, list)))
        if len(kept) >= ROWS or held >= BYTES:
            yield _batch(kept, schema)
            kept, held = [], 0
    if kept:
        yield _batch(kept, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def map_rows(df: DataFrame, work: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str | StructType) -> DataFrame:
    """``work`` over the row stream of each partition; the columns of ``df`` come as a tuple in their order."""
    ship(df.sparkSession)
    kind = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches):
        yield from write(work(read(batches)), arrow)

    return df.mapInArrow(run, kind)


def work_folder(spark, name: str) -> str:
    """A fresh folder for an intermediate table, in the shared place that the session names.

    ``spark.checkpoint.dir`` is read from the session. Only where the session runs on one machine may it be unset: a new
    temporary folder then takes its place. A cluster without it is an error, since its executors share no local folder.
    """
    import tempfile
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_folder(spark, name)
    # What the job shuffled is not needed once its rows are written.
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)
