"""Lineage cuts that survive a lost executor and go once nothing reads them, and broadcasts of a checked size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.errors import ConfigError

#: A table of at most this many rows of fixed-width columns may be broadcast.
BROADCAST_ROWS = 200_000
#: A table of one column of 8-byte ids may be broadcast up to this many rows (about 50 MB).
BROADCAST_IDS = 2_000_000
#: Narrow rows that a partition of a cut should hold at least, where the caller bounds their number.
PART_ROWS = 1 << 14


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's checkpoint folder; a local session without one gets a temporary folder, a cluster an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local"):
        raise ConfigError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="caseweave-"))


class Scratch:
    """The tables that a block of work has written, but for those it keeps for whoever called it."""

    def __init__(self, outer: Scratch | None) -> None:
        self.outer = outer
        self.tables: dict[str, DataFrame] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """Hand a table of :func:`cut` or :func:`store` to the block around this one."""
        path = df._cut_to
        if (mine := self.tables.pop(path, None)) is not None and self.outer is not None:
            self.outer.tables[path] = mine
        return df


_SCRATCH: ContextVar[Scratch | None] = ContextVar("caseweave_scratch", default=None)


@contextmanager
def scratch() -> Iterator[Scratch]:
    """A block whose cuts are deleted at its end, unless it keeps them: loops then hold what they need and not all they made."""
    own = Scratch(_SCRATCH.get())
    token = _SCRATCH.set(own)
    try:
        yield own
    finally:
        _SCRATCH.reset(token)
        for df in own.tables.values():
            discard(df)


def _written(df: DataFrame, path: str) -> DataFrame:
    df._cut_to = path
    if (own := _SCRATCH.get()) is not None:
        own.tables[path] = df
    return df


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    The files are on storage that all executors share, so the loss of one of
    them costs a task and not the data. ``rows`` is an upper bound of narrow
    rows, where the caller knows one: few rows are then written in few parts,
    as a loop over small tables would else be one over thousands of files.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, ceil(rows / PART_ROWS)))
    out = df.checkpoint(eager=True)
    return _written(out, out._jdf.queryExecution().logical().rdd().getCheckpointFile().get())


def store(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it again.

    For wide rows: columns stay compressed (by the session's codec, or the one
    named), and later stages read only theirs.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return _written(spark.read.parquet(path), path)


def stored_at(df: DataFrame) -> str | None:
    """Where the files of ``df`` are, if it comes straight from :func:`cut` or :func:`store`."""
    return vars(df).get("_cut_to")


def discard(df: DataFrame, spark: SparkSession | None = None) -> None:
    """Delete the files of a table that :func:`cut` or :func:`store` wrote, once nothing reads them.

    ``spark`` does it for a table whose own session has ended.
    """
    spark = spark or df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if (own := _SCRATCH.get()) is not None:
        own.tables.pop(df._cut_to, None)


def discard_at_exit(df: DataFrame) -> None:
    """The same when the driver ends, for a table that is read until then."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are at most ``limit``.

    Beyond the limit the join stays a shuffled one.
    """
    return F.broadcast(df) if rows <= limit else df
