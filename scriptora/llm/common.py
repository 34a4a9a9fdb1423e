"""What the operators of this subpackage share: written tables, tasks, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from scriptora.sources.shared import work_path

#: ASCII white space, the complement of the word class of every contract; bytes.split() and bytes.strip() use the same set.
SPACES = b" \t\n\r\x0b\x0c"


#: Bytes of the tables read, by the plan's estimate, for which a task is worth having.
SHARE = 32 << 20


def compact(df: DataFrame) -> DataFrame:
    """df in fewer tasks where its plan has many small ones: four tasks a core, and more as its tables take more than SHARE bytes a task.

    Tasks are put together without a shuffle. Small files and empty partitions
    cost an output file each; on large tables every split keeps its own task.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(min(1 << 30, max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-size // SHARE))))


def fresh(columns: Iterable[str], name: str) -> str:
    """name, with as many more underscores in front as it takes to clash with none of the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it from there: lineage ends, and lost executors cost nothing.

    Every later use reads the same rows, so a side effect or an order that a
    recomputation could change is fixed here.
    """
    path = work_path(df.sparkSession, name)
    compact(df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession, rows: int, per_task: int) -> int:
    """Tasks for so many rows: as many as the session's shuffles have, more where a task would get over per_task rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def batched(rows: Iterator[tuple], schema: pa.Schema, limit: int = 4096, weigh=None, most: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of at most limit rows; weigh(row) gives bytes, of which a batch has about most."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weigh(row) if weigh else 0
        if len(held) >= limit or size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), schema.types, strict=True)], schema=schema)
