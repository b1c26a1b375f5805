"""Keyed last-wins merges as set operations.

``latest`` is one aggregation (``max_by`` of the row by its order), so copies of a hot
key combine before the shuffle.  ``merge`` is one full outer join on the key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def _struct(columns) -> Column:
    return F.struct(*[F.col(c) for c in columns])


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` of each key; orders must be unique within a key."""
    return rows.groupBy(*key).agg(F.max_by(_struct([c for c in rows.columns if c not in key] or key), _struct(order)).alias("_row")).select(*key, "_row.*").select(*rows.columns)


def _same(old: DataFrame, new: DataFrame, key: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [old[k].eqNullSafe(new[k]) for k in key])


def merge(existing: DataFrame, new: DataFrame, key: list[str], order: list[str] | None = None, frozen: tuple[str, ...] = ()) -> DataFrame:
    """``existing`` with ``new`` merged in: matched rows take the new properties but for the ``frozen`` ones.

    Both have the same columns; ``order`` says which of several new rows of a key wins.
    ``change`` is created, updated or kept.
    """
    new = latest(new, key, order) if order else new
    columns = [c for c in existing.columns if c not in key]
    old, now = existing.withColumn("_old", F.lit(True)).alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    joined = old.join(now, reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]), "full_outer")
    pick = lambda c: F.when(F.col("n._new") & ~(F.lit(c in frozen) & F.col("o._old").isNotNull()), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    change = F.when(F.col("o._old").isNull(), "created").when(F.col("n._new").isNull(), "kept").otherwise("updated")
    keys = [F.when(F.col("n._new"), F.col(f"n.{k}")).otherwise(F.col(f"o.{k}")).alias(k) for k in key]
    return joined.select(*keys, *[pick(c) for c in columns], change.alias("change"))


def insert_if_absent(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``existing`` plus the new rows whose key it lacks (``NOT EXISTS`` as an anti join)."""
    return existing.unionByName(new.dropDuplicates(key).join(existing.select(*key), key, "left_anti").select(*existing.columns))


def delete_by(store: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """``store`` without the rows whose key is in ``gone``."""
    return store.join(gone.select(*key).distinct(), key, "left_anti")


def merge_edges(edges: DataFrame, ends: list[str], order: list[str]) -> DataFrame:
    """One edge for each pair of ends, with the properties of the last."""
    return latest(edges, ends, order)
