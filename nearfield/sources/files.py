"""Vector files: NumPy, CSV in two flavours, and the packed binary formats, read and written in row ranges.

.bin: u32 dims, u32 rows, then rows x dims float32; .ann: u32 dims, u32 bits, then bits x dims float32; all little-endian.
Frames are (vec_id, embedding); vec_id is the row's position. The binary formats are for exchange with other programs: they
are single files that must be visible to the executors at the same path. The engine's own store is Parquet.
"""

from __future__ import annotations

import os
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "vec_id long, embedding array<float>"
HEADER = struct.Struct("<II")
ROWS_PER_SPLIT = 65536


def arrow_batch(start: int, matrix: np.ndarray) -> pa.RecordBatch:
    rows, dims = matrix.shape
    flat = pa.array(np.ascontiguousarray(matrix, dtype=np.float32).reshape(-1))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * dims), flat)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + rows, dtype=np.int64)), lists], names=["vec_id", "embedding"])


def from_matrix(spark: SparkSession, matrix) -> DataFrame:
    """A list of lists or a 2-D array held by the driver."""
    matrix = np.asarray(matrix, dtype=np.float32)
    return spark.createDataFrame(pa.Table.from_batches([arrow_batch(0, matrix)]), SCHEMA)


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines (value, file, start) with their number line, counted through files in order of name; one row a split of a file is counted first."""
    at = Window.partitionBy("file", "start").orderBy("_m")
    sizes = lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("file", "start", F.coalesce(before, F.lit(0)).alias("before"))
    return lines.withColumn("_m", F.monotonically_increasing_id()).withColumn("at", F.row_number().over(at)).join(sizes, ["file", "start"]).select((F.col("before") + F.col("at") - 1).alias("line"), "value")


def read_csv(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Headerless numeric CSV. Lenient: blank lines and # comments are skipped. Strict: they, like any cell that is no number, are errors that name the line, and so is an empty file."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.input_file_block_start().alias("start"))
    if strict:
        if lines.isEmpty():
            raise ValueError(f"{path} is empty")
        cells = F.transform(F.split("value", ","), lambda x: F.trim(x).try_cast("float"))
        bad = F.exists(cells, lambda x: x.isNull())
        fail = F.raise_error(F.concat(F.lit("no number in line "), (F.col("line") + 1).cast("string"))).cast("array<float>")
        return _numbered(lines).select(F.col("line").alias("vec_id"), F.when(bad, fail).otherwise(cells).alias("embedding"))
    body = lines.withColumn("value", F.trim(F.regexp_replace("value", "#.*$", ""))).where("value <> ''")
    return _numbered(body).select(F.col("line").alias("vec_id"), F.transform(F.split("value", ","), lambda x: F.trim(x).cast("float")).alias("embedding"))


def read_header(path: str) -> tuple[int, int]:
    """(dims, rows) of a .bin file, whose size must be exactly right."""
    size = os.path.getsize(path)
    if size < HEADER.size:
        raise ValueError(f"{path} is too short for a header")
    with open(path, "rb") as f:
        dims, rows = HEADER.unpack(f.read(HEADER.size))
    if size != HEADER.size + 4 * dims * rows:
        raise ValueError(f"{path} has {size} bytes, its header asks for {HEADER.size + 4 * dims * rows}")
    return dims, rows


def _ranges(rows: int) -> list[tuple[int, int]]:
    return [(a, min(a + ROWS_PER_SPLIT, rows)) for a in range(0, rows, ROWS_PER_SPLIT)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self):
        return [InputPartition(r) for r in _ranges(self.shape()[0])] or [InputPartition((0, 0))]

    def read(self, partition):
        start, end = partition.value
        if end > start:
            yield arrow_batch(start, self.rows(start, end))


class _BinReader(_Reader):
    def shape(self):
        dims, rows = read_header(self.path)
        return rows, dims

    def rows(self, start, end):
        dims = self.shape()[1]
        return np.fromfile(self.path, "<f4", (end - start) * dims, offset=HEADER.size + 4 * dims * start).reshape(-1, dims)


class _NpyReader(_Reader):
    def shape(self):
        shape = np.load(self.path, mmap_mode="r").shape
        if len(shape) != 2:
            raise ValueError("embeddings must have two dimensions")
        return shape

    def rows(self, start, end):
        return np.load(self.path, mmap_mode="r")[start:end]


def _source(kind: str, reader: type) -> type:
    class Source(DataSource):
        @classmethod
        def name(cls):
            return kind

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return reader(self.options)

    return Source


BinSource, NpySource = _source("vector_bin", _BinReader), _source("vector_npy", _NpyReader)


def register(spark: SparkSession) -> None:
    """spark.read.format("vector_bin" | "vector_npy").load(path)"""
    spark.dataSource.register(BinSource)
    spark.dataSource.register(NpySource)


def read_bin(spark: SparkSession, path: str) -> DataFrame:
    read_header(path)
    register(spark)
    return spark.read.format("vector_bin").load(path)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    _NpyReader({"path": path}).shape()
    register(spark)
    return spark.read.format("vector_npy").load(path)


def write_bin(vectors: DataFrame, path: str) -> str:
    """One .bin file in vec_id order, written beside its target and then renamed. Rows are fetched partition by partition, so memory holds one partition; a ragged row is an error before anything is written."""
    from nearfield.plans.index import validate

    rows, dims = validate(vectors)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.tmp", "wb") as f:
        f.write(HEADER.pack(dims, rows))
        for r in vectors.select("vec_id", "embedding").repartitionByRange("vec_id").sortWithinPartitions("vec_id").toLocalIterator():
            f.write(np.asarray(r.embedding, dtype="<f4").tobytes())
    read_header(f"{path}.tmp")
    os.replace(f"{path}.tmp", path)
    return path


def write_ann(planes: np.ndarray, path: str) -> str:
    with open(path, "wb") as f:
        f.write(HEADER.pack(planes.shape[1], planes.shape[0]))
        f.write(np.ascontiguousarray(planes, dtype="<f4").tobytes())
    return path


def read_ann(path: str) -> np.ndarray:
    """Hyperplanes as bits x dims; signatures made with them put rows in the same buckets as the program that wrote the file."""
    dims, bits = read_header(path)
    return np.fromfile(path, "<f4", dims * bits, offset=HEADER.size).reshape(bits, dims).astype(np.float64)


def build_from_csv(spark: SparkSession, path: str, normalize: bool = False, force: bool = False, use_ann: bool = False) -> str:
    """CSV (strict) to <stem>_f32[_ann].bin beside it; an existing file is kept unless forced. use_ann only changes the name."""
    from nearfield.functions.vectors import normalize_lenient

    target = f"{os.path.splitext(path)[0]}_f32{'_ann' if use_ann else ''}.bin"
    if os.path.exists(target) and not force:
        return target
    vectors = read_csv(spark, path, strict=True)
    if normalize:
        vectors = vectors.withColumn("embedding", normalize_lenient("embedding").cast("array<float>"))
    return write_bin(vectors, target)
