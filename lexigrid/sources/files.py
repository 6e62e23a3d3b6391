"""Files and folders of any storage that Spark reaches, preconditions, external programs."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, fs = _at(spark, path)
    return fs.exists(place)


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a folder, by name; marker and hidden files left out."""
    place, fs = _at(spark, path)
    files = [(x.getPath().toString(), x.getLen()) for x in fs.listStatus(place) if x.isFile() and x.getPath().getName()[0] not in "._"]
    return sorted(files)


def size(spark: SparkSession, path: str) -> int:
    """Bytes below a path."""
    place, fs = _at(spark, path)
    return fs.getContentSummary(place).getLength()


def deleted(spark: SparkSession, path: str) -> bool:
    """Removes a file or folder, if it is there; whether it was."""
    place, fs = _at(spark, path)
    return fs.exists(place) and fs.delete(place, True)


def copied(spark: SparkSession, source: str, target: str) -> None:
    """Copies a file or folder between storages, the local one included, in place of what stands there."""
    (a, fs_a), (b, fs_b) = _at(spark, source), _at(spark, target)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs_a, a, fs_b, b, False, True, spark._jsc.hadoopConfiguration())


def merged(spark: SparkSession, folder: str, target: str) -> None:
    """The part files of a folder in the order of their names as one file, byte by byte, without a task that holds them."""
    place, fs = _at(spark, target)
    out = fs.create(place, True)
    try:
        for path, _ in listed(spark, folder):
            part, fs_part = _at(spark, path)
            data = fs_part.open(part)
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(data, out, 1 << 16, False)
            finally:
                data.close()
    finally:
        out.close()


def ordered_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(file, at, value): the lines of a folder's text files; by (file, at) they have the order of one stream over the files by name. ``at`` rises within a file, and says nothing else."""
    lines = spark.read.text(folder).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    return lines.select("file", F.struct("start", (F.monotonically_increasing_id() % (1 << 33)).alias("line")).alias("at"), "value")


def require(spark: SparkSession, present: list[str] = (), absent: list[str] = ()) -> None:
    """Raises FileNotFoundError or FileExistsError, with all paths at fault, before any work is done."""
    missing = [p for p in present if not exists(spark, p)]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    there = [p for p in absent if exists(spark, p)]
    if there:
        raise FileExistsError(", ".join(there))


def piped(lines: DataFrame, command: list[str], column: str = "value") -> DataFrame:
    """(value): what an external program prints for the lines of each task on its standard input; null lines are left out. A program that fails fails its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, encoding="utf-8") as p:
            import threading

            def feed() -> None:
                with p.stdin:
                    for b in batches:
                        p.stdin.writelines(f"{x}\n" for x in b.column(0).to_pylist())

            feeder = threading.Thread(target=feed)
            feeder.start()
            held: list[str] = []
            for line in p.stdout:
                held.append(line.removesuffix("\n"))
                if len(held) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held)], names=["value"])
                    held = []
            feeder.join()
            if p.wait():
                raise RuntimeError(f"{command[0]} ended with {p.returncode}")
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held)], names=["value"])

    return lines.select(column).where(F.col(column).isNotNull()).mapInArrow(run, "value string")


def fan_out(spark: SparkSession, tasks: list[str], run: Callable[[str], str]) -> DataFrame:
    """(task, result): a function over a list of tasks, a partition each, as for external programs that take a machine to themselves."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_pylist()
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([run(x) for x in names], pa.string())], names=["task", "result"])

    numbered = spark.createDataFrame(list(enumerate(tasks)), "at int, task string")
    return numbered.repartitionByRange(max(1, len(tasks)), "at").select("task").mapInArrow(each, "task string, result string")
