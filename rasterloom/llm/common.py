"""Helpers shared by the text operators: tables in the shared folder, checked broadcasts, Arrow maps."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A set of ids is broadcast up to so many rows (a hash relation of about 40 MB); beyond, it is joined by shuffle.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32_000_000
#: Rows of an Arrow batch, which may hold whole texts.
BATCH_ROWS = 500
ASCII_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"

_own_dir: dict[str, str] = {}
_scopes: list[Staging] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one, but only if all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local(\[[^-]*\])?$", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share; it is unset, and the master is {master}")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="stages-")
    return _own_dir[app]


class Staging:
    """Owns the tables that are staged while it is open, and deletes them when it closes, but for those that are kept.

    What is kept passes to the scope around this one. Without any, it lives as long as the application: Hadoop deletes it
    when the driver ends. So a result stays readable whatever other operators do meanwhile.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Staging:
        _scopes.append(self)
        return self

    def __exit__(self, *_) -> None:
        _scopes.remove(self)
        for path in self.paths:
            delete(self.spark, path)

    def folder(self, name: str) -> str:
        """A new folder in shared storage that goes with this scope; whoever asks fills it."""
        path = _new_path(self.spark, name)
        self.paths.append(path)
        delete_at_end(self.spark, path)
        return path

    def keep(self, table: DataFrame) -> DataFrame:
        """A staged table that outlives this scope."""
        self.paths.remove(table.staged_at)
        at = _scopes.index(self)
        if at:
            _scopes[at - 1].paths.append(table.staged_at)
        return table

    def free(self, *tables: DataFrame) -> None:
        """Delete staged tables that nothing will read again."""
        for table in tables:
            self.paths.remove(table.staged_at)
            delete(self.spark, table.staged_at)


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _file_system(spark, path)
    return files.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    where, files = _file_system(spark, path)
    files.delete(where, True)
    files.cancelDeleteOnExit(where)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the driver ends."""
    where, files = _file_system(spark, path)
    files.deleteOnExit(where)


def _new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/stages/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, rows: int | None = None, rows_per_file: int = 100_000) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, so a lost executor costs no recomputation.

    rows: a bound on its rows, if one is known. A small table is then written in few files, however many partitions it
    has; a large one keeps them all. The innermost open Staging owns the table.
    """
    spark = df.sparkSession
    path = _new_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // rows_per_file)))
    if _scopes:
        _scopes[-1].paths.append(path)
    with small_batches(spark):
        df.write.parquet(path)
    delete_at_end(spark, path)
    found = spark.read.schema(df.schema).parquet(path)
    found.staged_at = path
    return found


def checked(small: DataFrame, rows: int | None = None) -> DataFrame:
    """small, with a broadcast hint only if it is shown to have at most BROADCAST_ROWS rows and BROADCAST_BYTES bytes.

    rows: its count, if that is known already; then only the bytes of strings are summed, and only if it has any.
    """
    wide = [F.octet_length(f.name) for f in small.schema if f.dataType.typeName() in ("string", "binary")]
    if rows is None or wide and rows <= BROADCAST_ROWS:
        total = sum((F.coalesce(c, F.lit(0)).cast("long") for c in wide), F.lit(8 * len(small.columns)).cast("long"))
        rows, held = small.agg(F.count(F.lit(1)), F.coalesce(F.sum(total), F.lit(0))).first()
    else:
        held = 8 * len(small.columns) * rows
    return F.broadcast(small) if rows <= BROADCAST_ROWS and held <= BROADCAST_BYTES else small


def in_arrow(df: DataFrame, run: Callable, schema: str, after: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow in slices of BATCH_ROWS rows. `after` runs at the end of each task: Python workers live on between tasks
    and stages, and what one operator remembers should not weigh on the next."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batch.slice(at, BATCH_ROWS) for batch in batches for at in range(0, len(batch), BATCH_ROWS))
        finally:
            if after is not None:
                after()
            give_back()

    return df.mapInArrow(whole, schema)


def give_back() -> None:
    """Return freed memory to the system, where the C library can: a worker that lives on would keep it from the others."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Texts are long: a batch of them is held by the scan, by Arrow and by Python at once. Inside, batches are of BATCH_ROWS
    rows; the session's own settings hold again afterwards."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {name: spark.conf.get(name) for name in names}
    for name, value in before.items():
        if not 0 < int(value) <= BATCH_ROWS:
            spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of df has it, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        found.append(name)
    return found


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict[str, list]]], schema: str) -> DataFrame:
    """mapInArrow over record batches; fn yields dictionaries of columns for each batch."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    kinds = arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in fn(batch):
                yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, kinds, strict=True)], names)

    return in_arrow(df, run, schema)


def arrow_types(schema: str) -> list[pa.DataType]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    return [kinds[part.strip().split(" ")[1]] for part in schema.split(",")]


def lowered(batch_column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text (null: empty) with A-Z in lower case; bytes.lower() leaves all other bytes alone."""
    column = batch_column.cast(pa.binary()) if not pa.types.is_binary(batch_column.type) else batch_column
    return [(x or b"").lower() for x in column.to_pylist()]


def fold_of(column: str, folds: int):
    """crc32 of an id written as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(folds)
