"""Messages delivered at least once: keep exactly one copy of each, and admit new batches.

Identifiers follow the key rule of the caller (pass cleaned columns). A NULL part of an identifier is a value
of its own, equal to other NULLs. Empty input gives empty output; every other column may be NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechlytics.session import fresh


def _order(columns: list[str]) -> list:
    return [F.col(f"`{c}`").asc_nulls_last() for c in columns]


def first_delivery(
    messages: DataFrame, keys: list[str], arrival: str, copies: str = "n_copies", salts: int = 16
) -> DataFrame:
    """One row for each identifier: the copy that arrived first, and in ``copies`` how many there were.

    Ties in ``arrival`` are decided by all remaining columns in name order, NULLs last, so the survivor does
    not depend on the physical order; rows equal in every column are interchangeable. A NULL arrival counts
    as the latest.

    The ranking runs in two steps. The first ranks within (identifier, salt), where the salt spreads the rows
    of one identifier over ``salts`` groups; it leaves at most ``salts`` rows an identifier for the second.
    No task therefore sorts more than a salt's share of an identifier that holds a third of all messages.
    """
    salt, rank, count = fresh(messages, "salt", "rank", "count")
    rest = sorted(c for c in messages.columns if c not in keys and c != arrival)
    order = _order([arrival, *rest])
    by = [F.col(f"`{k}`") for k in keys]
    # The salt follows the position of a row, not its content: redelivered rows are often equal throughout.
    salted = messages.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    inner = Window.partitionBy(*by, F.col(salt))
    some = (
        salted.withColumn(rank, F.row_number().over(inner.orderBy(*order)))
        .withColumn(count, F.count(F.lit(1)).over(inner))
        .filter(F.col(rank) == 1)
        .drop(salt)
    )
    outer = Window.partitionBy(*by)
    return (
        some.withColumn(rank, F.row_number().over(outer.orderBy(*order)))
        .withColumn(copies, F.sum(count).over(outer))
        .filter(F.col(rank) == 1)
        .drop(rank, count)
    )


def redelivered(messages: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The identifiers that stand in more than one row, one row each."""
    slim = messages.select(*keys, arrival)
    (copies,) = fresh(slim, "copies")
    return first_delivery(slim, keys, arrival, copies).filter(F.col(copies) > 1).select(*keys)


def admit_batch(stored: DataFrame, batch: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The messages of a new batch that are to be stored: first copies whose identifier is not stored yet.

    The batch is reduced to one row an identifier before the anti-join, so a hot identifier reaches the join
    once; of the stored side only the identifiers take part. NULL parts of identifiers match each other.
    """
    (copies,) = fresh(batch, "copies")
    first = first_delivery(batch, keys, arrival, copies).drop(copies)
    known = stored.select(*keys).distinct().alias("known")
    same = None
    for k in keys:
        part = F.col(f"new.`{k}`").eqNullSafe(F.col(f"known.`{k}`"))
        same = part if same is None else same & part
    return first.alias("new").join(known, same, "left_anti")
