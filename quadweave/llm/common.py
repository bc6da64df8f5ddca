"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of whole texts that are handled at a time.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches of whole texts small, in the JVM too; a lower setting of the session stays.

    The setting is read when a query runs, not when it is made, so it can't be put back here.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def slices(batches: Iterator, rows: int = BATCH_ROWS) -> Iterator:
    """The batches in slices of at most so many rows, whatever the session's setting is."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One is made only where the session names none and all runs in one
    process; a cluster without spark.checkpoint.dir is an error, as its machines have no folder in common."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    own = sc.getCheckpointDir()
    if own is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        made = tempfile.mkdtemp(prefix="quadweave-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        sc.setCheckpointDir("file://" + made)
        own = sc.getCheckpointDir()
    return own


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder, which survives lost executors."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    out = df.checkpoint(eager=True)
    give_back(spark)
    return out


def give_back(spark: SparkSession) -> None:
    """Return native memory that is free again to the system: the driver's allocators keep what compiled plans, sent
    tables and broadcasts took, the more the more jobs ran. Where there is no way to ask for that, they go on keeping it."""
    pa.default_memory_pool().release_unused()
    if os.name == "posix" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        args = array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        args[2], args[3] = array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
        # by the interface: the server's own class is closed to callers
        methods = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods()
        invoke = next(m for m in methods if m.getName() == "invoke")
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        pass  # another JVM, an older one, or another C library


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """Write whole texts as a Parquet table in the shared folder; the table read back, and its path."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    give_back(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table that written() made and nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def one_each(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of the input can't clash with those made here."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values in a sorted array."""
    if not len(keys):
        return np.zeros(0, int), np.zeros(0, int)
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])


def whole_groups(tables: Iterator, key: str) -> Iterator:
    """Arrow batches of a partition sorted by key -> pandas frames that hold whole groups, never a part of one.

    Only the last, still open group is carried to the next batch. Groups must be bounded by the caller.
    """
    import pandas as pd

    open_part: list = []
    for batch in tables:
        pdf = batch.to_pandas() if hasattr(batch, "to_pandas") else batch
        if not len(pdf):
            continue
        k = pdf[key].to_numpy()
        if open_part and open_part[-1][key].iloc[-1] != k[0]:
            yield pd.concat(open_part, ignore_index=True)
            open_part = []
        if k[0] == k[-1]:
            open_part.append(pdf)
            continue
        cut = int(np.flatnonzero(k != k[-1])[-1]) + 1
        yield pd.concat([*open_part, pdf.iloc[:cut]], ignore_index=True)
        open_part = [pdf.iloc[cut:]]
    if open_part:
        yield pd.concat(open_part, ignore_index=True)


class Forest:
    """Union-find over small integers."""

    def __init__(self, n: int = 0):
        self.up = list(range(n))

    def add(self) -> int:
        self.up.append(len(self.up))
        return len(self.up) - 1

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def tokenizer_path(name: str) -> str:
    """Where a vocabulary file of the installed public tokenizers lies."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
