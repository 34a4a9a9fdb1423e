"""Binary files that tasks write to the shared folder and read back, through pyarrow's file systems."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptora.llm.common import materialise

#: Ids (or bytes, where a writer counts those) of the files that one task reads back.
TOGETHER = 1 << 24
MANIFEST = "part int, path string, docs long, ids long"


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of file:, s3:, gs: or hdfs: (where the native client is installed) or of a plain path."""
    return fs.FileSystem.from_uri(uri)


def write_files(df: DataFrame, folder: str, suffix: str, write: Callable[[Iterator[pa.RecordBatch], pa.NativeFile], tuple[int, int]]) -> DataFrame:
    """One file for each partition of df that has rows; returns the manifest, a written table (part, path, docs, ids).

    Each attempt of a task writes a file of its own name and only the manifest
    says which count: those of attempts that Spark committed. A retried or
    speculative attempt, or a lost executor, leaves at most a file that nothing
    names. The manifest's few rows are shuffled into a few files of their own.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        part = TaskContext.get().partitionId()

        def every() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        system, path = open_fs(f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.{suffix}")
        system.create_dir(path.rpartition("/")[0], recursive=True)
        with system.open_output_stream(path, compression=None) as out:
            docs, ids = write(every(), out)
        scheme = folder.partition("://")[0] + "://" if "://" in folder else ""
        full = f"{scheme}{path}" if scheme == "file://" else f"{folder}/{path.rpartition('/')[2]}"
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([full]), pa.array([docs]), pa.array([ids])], ["part", "path", "docs", "ids"])

    return materialise(df.mapInArrow(task, MANIFEST).repartition("part"), "manifest")


def before(manifest: DataFrame) -> DataFrame:
    """manifest with `before`, the ids in all files before each one; there is one row for each file, so one task can hold them."""
    return manifest.withColumn("before", F.sum("ids").over(Window.orderBy("part")) - F.col("ids"))


def read_files(manifest: DataFrame, read: Callable[[pa.NativeFile, dict], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What read gives for each file, a file for each row of the manifest; a task gets files of about TOGETHER ids, fewer where that leaves cores idle."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = open_fs(row["path"])
                with system.open_input_file(path) as source:
                    yield from read(source, row)

    files, ids = manifest.agg(F.count("*"), F.coalesce(F.sum("ids"), F.lit(0))).first()
    tasks = max(1, min(files, max(4 * manifest.sparkSession.sparkContext.defaultParallelism, -(-ids // TOGETHER))))
    return manifest.repartition(tasks).mapInArrow(task, schema)
