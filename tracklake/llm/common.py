"""Small helpers that all corpus operators share."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A private folder is made only in local mode with the setting unset, as in
    unit tests; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tracklake-")
    sc.setCheckpointDir(configured)
    return sc._jsc.sc().getCheckpointDir().get()


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_open: list[list[str]] = []


def spool(df: DataFrame, *, batch: int | None = None, keep: bool = False) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Cuts the lineage: after a lost executor only the reader's tasks are rerun. ``batch`` bounds the
    rows that a Python worker gets at once while this table is written. Within ``scratch`` the table goes
    with the block, or with ``keep`` when the block around that one ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spool-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH)
    try:
        if batch:
            spark.conf.set(_BATCH, str(batch))
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    if len(_open) > keep:
        _open[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the tables that were spooled inside. For finished work only: nothing may read them later."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            remove(spark, path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings are changed inside, and as before afterwards."""
    own = spark.conf.getAll  # what is set, without defaults
    before = {k: own.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def remove(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def raw_texts(column: pa.Array, step: int = 256) -> Iterator[bytes | None]:
    """The UTF-8 bytes of a string column, without a copy of the whole batch."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for k in range(0, len(column), step):
        yield from column.slice(k, step).cast(kind).to_pylist()


def by_arrow(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], step: int = 1024) -> DataFrame:
    """``make()`` once a task, then its function on slices of at most ``step`` rows; it gives the columns by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for k in range(0, batch.num_rows, step):
                yield pa.RecordBatch.from_pydict(work(batch.slice(k, step)))

    return df.mapInArrow(run, schema)


def learn(rows: DataFrame, fit: Callable[[pd.DataFrame], object]):
    """The model that ``fit`` makes of a bounded table, in one task on an executor.

    Neither the rows nor what the fit holds meet in the driver; it gets the pickled model.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        part = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=names)
        yield pd.DataFrame({"model": [pickle.dumps(fit(part))]})

    names = rows.columns
    got = rows.coalesce(1).mapInPandas(run, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else fit(pd.DataFrame(columns=names))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, whatever uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def row_key(text: Column) -> Column:
    """Two independent hashes and the length: tells apart rows of one doc_id."""
    return F.struct(F.xxhash64(text).alias("h1"), F.hash(text).alias("h2"), F.length(text).alias("n"))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
