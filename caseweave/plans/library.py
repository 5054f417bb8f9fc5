"""A corpus of tables, derived once: what a search reads instead of deriving it for every question.

Documents, passages, postings, statistics, identifiers and vectors of a folder
of tables are written as Parquet to the shared folder when they are first asked
for, and read from there as long as the tables they come from stay the same (by
path, length and time of change of their files) and the session lasts. They go
when the driver ends, or when a later session of it first derives a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caseweave.plans.durable import discard, discard_at_exit, store, stored_at

_BUILT: dict[tuple[str, str, str], tuple[str, DataFrame]] = {}
#: Passages take two thirds of the bytes of the usual codec, postings five sixths.
CODEC = "zstd"


def state_of(spark: SparkSession, path: str) -> str:
    """The files of a table, as one string that changes when they do."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    own = fs.getFileStatus(where)
    files = sorted(fs.listStatus(where), key=lambda f: f.getPath().toString()) if own.isDirectory() else [own]
    return "|".join(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in files)


def kept(spark: SparkSession, folder: str, source: str, name: str, derive: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` derived from ``folder/source.parquet``: written once, then read."""
    key, state = (spark.sparkContext.applicationId, folder, name), state_of(spark, f"{folder}/{source}.parquet")
    found = _BUILT.get(key)
    if found is not None and found[0] == state:
        return found[1]
    for ended in [k for k in _BUILT if k[0] != key[0]]:  # a driver has one session at a time
        discard(_BUILT.pop(ended)[1], spark)
    out = derive()
    if stored_at(out) is None:
        out = store(out, CODEC)
    discard_at_exit(out)
    if found is not None:
        discard(found[1])
    _BUILT[key] = (state, out)
    return out
