"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.session import scratch_path


def in_fold(id_column: str, folds: int, fold: int) -> Column:
    """True where crc32 of the id's text falls into ``fold``; a null id falls into none."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % folds == fold, F.lit(False))


#: Keys with more than this part of all rows are joined apart, see ``joined_apart``.
SHARE = 4096
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Cuts the lineage and survives lost executors. ``forget`` deletes the table.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` returned, once nothing reads them any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(table))
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def joined_apart(rows: DataFrame, marks: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``marks``, unique by ``keys``, however many rows one key holds.

    The column ``rows`` of ``marks`` says how many rows hold the key. Keys with more than
    a ``SHARE``-th of all counted rows are fewer than ``SHARE``: they are broadcast. The rest
    is joined by a shuffle in which no key is large. ``how`` is inner or left. Both
    tables should be stored.
    """
    most = max((marks.agg(F.sum("rows")).first()[0] or 0) // SHARE, 1)
    hot = marks.where(F.col("rows") > most).drop("rows").withColumn("_hot", F.lit(True))
    met = rows.join(F.broadcast(hot), keys, "left")
    rest = met.where("_hot is null").select(rows.columns).join(marks.where(F.col("rows") <= most).drop("rows"), keys, how)
    return met.where("_hot").drop("_hot").unionByName(rest)


def sampled(df: DataFrame, key: str, bounds: dict, id_column: str) -> DataFrame:
    """Keep each row of class ``key`` with its class's rate, decided by a hash of the id.

    ``bounds`` maps a class to a rate; the expected number of rows is then bounded
    however large the table is, and the choice is the same at every run.
    """
    if not bounds:
        return df.where(F.lit(False))
    rate = F.try_element_at(F.create_map(*[F.lit(x) for pair in bounds.items() for x in (pair[0], float(pair[1]))]), F.col(key))
    return df.where(F.pmod(F.xxhash64(F.col(id_column)), F.lit(1 << 30)) < rate * F.lit(float(1 << 30)))


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        start = 0
        for i, row in enumerate(rows):
            if row != last:
                if last is not None and (held or i > start):
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, row
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
