"""References to records that do not exist, and what hangs from them.

``temporal_orphans`` finds the references whose parent is missing, not there yet, or gone at the time of the
reference. ``orphan_cascade`` then goes down the foreign-key graph to a fixpoint: a record all of whose parents
under one key are orphaned is an orphan by inheritance.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlytics.session import Written, fresh

#: Tasks that the references of one id are spread over.
SALTS = 8


def temporal_orphans(references: DataFrame, parents: DataFrame) -> DataFrame:
    """The rows of ``references`` (ref_id, ref_time, ...) without a parent valid at ref_time, with a reason.

    ``parents`` has (parent_id, valid_from, valid_to): a parent holds from valid_from up to, not including,
    valid_to (NULL: for good; a NULL valid_from never holds). reason is ``missing`` (no parent has the id),
    ``early`` (ref_time lies before every valid_from) or ``removed``. A NULL ref_id refers to nothing and is
    left out; an empty id is an id. A NULL ref_time finds no valid parent and counts as removed, or missing.

    Plan: one anti-join on the id with the period as residual condition, and one left join of what is left
    (the orphans only) against one row an id. References of one id are spread over SALTS tasks, for each of which the
    few periods of the parents are repeated. Parents written several times are reduced before the join.
    """
    salt, *_ = fresh(references, "salt")
    refs = references.filter(F.col("ref_id").isNotNull())
    refs = refs.withColumn(salt, F.pmod(F.xxhash64(*references.columns), F.lit(SALTS))).alias("r")
    periods = parents.filter(F.col("parent_id").isNotNull()).select("parent_id", "valid_from", "valid_to")
    each = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).alias(salt)
    valid = periods.filter(F.col("valid_from").isNotNull()).distinct().select("*", each).alias("p")
    lost = refs.join(
        valid,
        (F.col("r.ref_id") == F.col("p.parent_id")) & (F.col(f"r.{salt}") == F.col(f"p.{salt}"))
        & (F.col("r.ref_time") >= F.col("p.valid_from"))
        & (F.col("p.valid_to").isNull() | (F.col("r.ref_time") < F.col("p.valid_to"))),
        "left_anti",
    )
    first = periods.groupBy("parent_id").agg(F.min("valid_from").alias("first_from"))
    known = first.select("*", each).alias("k")
    reason = (
        F.when(F.col("k.parent_id").isNull(), F.lit("missing"))
        .when(F.col("r.ref_time") < F.col("k.first_from"), F.lit("early"))
        .otherwise(F.lit("removed"))
    )
    met = (F.col("r.ref_id") == F.col("k.parent_id")) & (F.col(f"r.{salt}") == F.col(f"k.{salt}"))
    return lost.join(known, met, "left").select("r.*", reason.alias("reason")).drop(salt)


@dataclass(frozen=True)
class ForeignKey:
    """Column ``child_column`` of ``child`` refers to ``parent_column`` of ``parent``."""

    child: str
    child_column: str
    parent: str
    parent_column: str


def orphan_cascade(tables: dict[str, DataFrame], keys: list[ForeignKey], direct: dict[str, DataFrame]) -> DataFrame:
    """All orphans as (table_name, row_id, kind, level), kind ``direct`` or ``inherited``.

    Every table has a unique ``row_id`` and the columns its keys name; ``direct`` gives, for a table, the
    row_ids already found orphaned (level 0) by whatever rule holds there, such as ``temporal_orphans``. For
    the keys in ``keys``, a reference that no parent row has is direct as well, and a row is inherited at
    level n+1 when parent rows exist under its reference but all of them are orphaned by level n. A NULL
    reference refers to nothing. A row is reported once, at its lowest level. Cycles end, as the set of
    orphans only grows.

    Each round semi-joins only the keys of the newly orphaned parents with their children, reduced to
    distinct values first; the state is written to the shared folder between rounds. The driver sees counts.
    """
    spark = next(iter(tables.values())).sparkSession
    names = sorted(tables)
    ids = {n: tables[n].schema["row_id"].dataType for n in names}

    def tagged(name: str, rows: DataFrame, kind: str, level: int) -> DataFrame:
        return rows.select(
            F.lit(name).alias("table_name"),
            F.col("row_id").cast("string").alias("row_id"),
            F.lit(kind).alias("kind"),
            F.lit(level).alias("level"),
        )

    def dangling(k: ForeignKey) -> DataFrame:
        there = tables[k.parent].select(F.col(k.parent_column).alias("__key")).distinct()
        child = tables[k.child].filter(F.col(k.child_column).isNotNull())
        return child.join(there, F.col(k.child_column) == F.col("__key"), "left_anti")

    start = [tagged(n, d, "direct", 0) for n, d in direct.items()] + [
        tagged(k.child, dangling(k), "direct", 0) for k in keys
    ]
    found = Written(reduce(DataFrame.unionByName, start).distinct(), "orphans-0")
    written, level = [found], 0
    while True:
        everything = reduce(DataFrame.unionByName, [w.read() for w in written])
        newest = written[-1].read()
        steps = []
        for k in keys:
            of_parent = everything.filter(F.col("table_name") == k.parent).select(
                F.col("row_id").cast(ids[k.parent]).alias("__lost")
            )
            new_parent = newest.filter(F.col("table_name") == k.parent).select(
                F.col("row_id").cast(ids[k.parent]).alias("__lost")
            )
            parent = tables[k.parent].select("row_id", F.col(k.parent_column).alias("__key"))
            touched = parent.join(new_parent, F.col("row_id") == F.col("__lost"), "left_semi").select("__key").distinct()
            # Only the other rows of the touched keys can keep one alive.
            beside = parent.join(touched, "__key", "left_semi")
            alive = beside.join(of_parent, F.col("row_id") == F.col("__lost"), "left_anti").select("__key").distinct()
            dead = touched.join(alive, "__key", "left_anti")
            child = tables[k.child].join(dead, F.col(k.child_column) == F.col("__key"), "left_semi")
            steps.append(tagged(k.child, child, "inherited", level + 1))
        fresh_rows = reduce(DataFrame.unionByName, steps).distinct() if steps else None
        if fresh_rows is None:
            break
        fresh_rows = fresh_rows.join(everything.select("table_name", "row_id"), ["table_name", "row_id"], "left_anti")
        step = Written(fresh_rows, f"orphans-{level + 1}")
        if step.read().isEmpty():
            step.drop()
            break
        written.append(step)
        level += 1
    return reduce(DataFrame.unionByName, [w.read() for w in written])
