"""What the operators share: the shared folder, published tables, words."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of two or three longs that a join may broadcast (about 20 MB).
MAX_BROADCAST = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the cluster names none, a local session (tests) gets a temporary one; any other session is refused, as
    its executors could not see a folder of the driver.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        sc = spark.sparkContext
        if (sc.getCheckpointDir() or "") == "":
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="tally-"))
        base = sc.getCheckpointDir()
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tally-{name}-{uuid.uuid4().hex}"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that df has already (whatever their case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def publish(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: the lineage is cut, and a lost executor loses nothing.

    The table belongs to whoever owns the folder; results that are read lazily still need it. `discard` deletes those
    that nothing reads any more.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._published = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes published tables; anything else is left alone."""
    for t in tables:
        path = None if t is None else t.__dict__.pop("_published", None)
        if path:
            jvm = t.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def short(keys: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """A published table of ids and hashes, to be broadcast if it is counted to have `most` rows at most.

    A longer one is joined by whatever the planner chooses, in the end by sorting both sides.
    """
    return F.broadcast(keys) if keys.count() <= most else keys


_kept: dict[str, dict] = {}


def kept(work: str) -> dict:
    """What this Python worker remembers from task to task for a kind of work; what it remembers for others is let go."""
    for k in _kept.keys() - {work}:
        del _kept[k]
    return _kept.setdefault(work, {})


def trim() -> None:
    """Gives memory that this process has freed back to the system: Arrow's and the C library's."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable, work: str = "") -> Callable:
    """run, for mapInArrow, in a Python worker that keeps nothing of other work, nor free memory when the task ends.

    Workers stay between tasks and stages, so what one stage leaves in them counts in all later ones.
    """

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(work)
        yield from run(batches)
        trim()

    return task


def bind(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, though body mentions it often, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    """Words of a text in order; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")
