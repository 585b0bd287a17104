"""What the operators of this subpackage share: tables, written intermediate tables, batches, folds and samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of text that a Python function works on at once. Spark itself bounds the bytes of the batches
#: that it sends to a worker; what a function makes of a text can be 50 times its size, hence the finer slices.
SLICE_ROWS = 256
SLICE_BYTES = 1 << 18
#: Rows and bytes of a batch that Spark sends to a worker, unless the session sets its own: an executor holds a batch
#: outside its heap, up to twice while it grows, for each of its tasks, and the worker holds it again.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2048", "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 22)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], *texts: str, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut to at most ``rows`` rows and about ``size`` bytes in the given columns of texts or numbers; a value is never cut."""
    for b in batches:
        ends = np.zeros(b.num_rows, np.int64)
        for name in texts:
            column = b.column(name)
            length, width = (pc.list_value_length, 8) if pa.types.is_list(column.type) else (pc.binary_length, 1)
            ends += pc.fill_null(length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) * width
        np.cumsum(ends, out=ends)
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            upto = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, side="right"))))
            yield b.slice(at, upto - at)
            at = upto
        pa.default_memory_pool().release_unused()  # workers are kept, and so would be what their largest batch took


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside send small batches to Python; the session's settings are as before after it."""
    own = [key for key in BATCHES if spark.conf.get(key, None) is None]
    for key in own:
        spark.conf.set(key, BATCHES[key])
    try:
        yield
    finally:
        for key in own:
            spark.conf.unset(key)


def bound_batches(spark: SparkSession) -> None:
    """From now on the session sends small batches to Python, where it sets no sizes of its own.

    For a result that its caller runs later: the session's settings at that time count, so these stay set.
    """
    for key, most in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, most)


def unused(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the shared folder that the cluster names in spark.checkpoint.dir.

    Only a local session, whose tasks all run on this machine, may leave the setting out.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def _local_folder(made: list[str] = []) -> str:  # noqa: B006  one folder for the process
    if not made:
        made.append(tempfile.mkdtemp(prefix="tidecue-"))
    return made[0]


#: Folders written since the innermost scope of this thread began; None outside any scope.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What is settled inside goes at the end, also after an error. Each thread has its own scopes."""
    made: list[str] = []
    token = _written.set(made)
    try:
        yield
    finally:
        _written.reset(token)
        delete(spark, made)


def settle(df: DataFrame, kind: str, owner: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: later stages start there when executors are lost.

    It goes with the innermost scope, or with the given owner's. Outside any scope it stays, like a
    checkpoint, until the cluster's cleaning.
    Python functions get their rows in small batches meanwhile.
    """
    path = shared_folder(df.sparkSession, kind)
    owner = _written.get() if owner is None else owner
    if owner is not None:
        owner.append(path)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(kind: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """An operator with a scope of its own, whose result is settled in the scope of its caller."""

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(operator)
        def run(df: DataFrame, *args, **options) -> DataFrame:
            outer = _written.get()
            with scope(df.sparkSession):
                return settle(operator(df, *args, **options), kind, [] if outer is None else outer)

        return run

    return wrap


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document belongs to the fold that no classifier learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def counted(df: DataFrame, most: int) -> DataFrame:
    """The frame, marked to be broadcast if it has no more than ``most`` rows; else Spark joins it by a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def few(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """The frame in as many partitions as so many rows need, and two for each core at least.

    For tables of distinct or aggregated keys, whose partitions are alike: small ones do not become a task and a file
    for every shuffle partition. No rows are moved.
    """
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def in_sample(key: str, n: int, most: int, seed: int = 17) -> Column:
    """Whether a row is among about ``most`` of ``n`` rows, chosen by a hash of the key: the same rows in every run.

    The share kept is set a little low, so that the bound holds with a wide margin of chance.
    """
    share = 1.0 if n <= most else (most - 4 * most**0.5) / n
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))


def bounded_sample(df: DataFrame, key: str, most: int, seed: int = 17) -> DataFrame:
    """About ``most`` rows at most; the count reads one column."""
    return df.where(in_sample(key, df.select(key).count(), most, seed))
