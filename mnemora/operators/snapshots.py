"""What changed between consecutive full snapshots of a table.

``snapshot_changes`` follows the relational recipe: ``EXCEPT ALL`` in both directions removes every row that two
consecutive deliveries share, and a full join of the two (small) residues by key labels what is left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.runtime import broadcast_if_small


def value_set(array: Column) -> Column:
    """An array as a set: sorted distinct non-null elements; null is the empty set."""
    return F.array_sort(F.array_distinct(F.array_compact(F.coalesce(array, F.array().cast("array<string>")))))


def snapshot_changes(
    snapshots: DataFrame,
    group: str = "graph_id",
    key: str = "key",
    snapshot_no: str = "snapshot_no",
    values: Sequence[str] = ("name", "kind", "confidence"),
    sets: Sequence[str] = ("aliases",),
) -> DataFrame:
    """Keys added, removed or changed between each delivery of a group and the group's delivery before it.

    Returns ``(group, key, snapshot_no, change_kind)``, one row per key that differs; ``snapshot_no`` is the later
    delivery. ``values`` are compared as they are (null is a value of its own, -0.0 equals 0.0), ``sets`` as sets
    (order, repeats and null elements mean nothing; null equals empty). Defined cases: identical repeated rows count
    once; a key delivered with several differing rows is compared as the set of its rows; a group's first delivery
    gives nothing; null keys form one key of their own; rows whose group or number is null are ignored; other
    columns, whatever their names, are never read; an empty table gives no rows.
    """
    kinds = dict(snapshots.dtypes)
    fields = [(F.col(v) + F.lit(0.0) if kinds[v] in ("double", "float") else F.col(v)).alias(f"v{i}") for i, v in enumerate(values)]
    fields += [value_set(F.col(s)).alias(f"s{i}") for i, s in enumerate(sets)]
    given = snapshots.where(F.col(group).isNotNull() & F.col(snapshot_no).isNotNull())
    # The values travel as a digest of 128 bits. The rows of one key are summed up as the exclusive or of theirs and
    # their number, which partial aggregation does before the shuffle, however many rows a key has.
    digest = F.md5(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
    half = lambda at: F.conv(F.substr(digest, F.lit(at), F.lit(15)), 16, 10).cast("bigint")
    single = given.select(F.col(group).alias("_g"), F.col(snapshot_no).alias("_n"), F.col(key).alias("_k"), half(1).alias("_x"), half(17).alias("_y")).distinct()
    rows = single.groupBy("_g", "_n", "_k").agg(F.bit_xor("_x").alias("_x"), F.bit_xor("_y").alias("_y"), F.count(F.lit(1)).alias("_c"))
    # One row per group and delivery: bounded by the number of deliveries, never by their rows.
    order = Window.partitionBy("_g").orderBy("_n")
    deliveries = given.select(F.col(group).alias("_g"), F.col(snapshot_no).alias("_n")).distinct()
    deliveries = deliveries.withColumn("_next", F.lead("_n").over(order)).withColumn("_first", F.lag("_n").over(order).isNull())
    # Partitioned once by group and key: both EXCEPT ALL and their unions keep that partitioning and reuse the exchange.
    placed = rows.repartition("_g", "_k").join(broadcast_if_small(deliveries), ["_g", "_n"])
    same_values = ["_x", "_y", "_c"]
    later = placed.where(~F.col("_first")).select("_g", F.col("_n").alias("_at"), "_k", *same_values)
    earlier = placed.where(F.col("_next").isNotNull()).select("_g", F.col("_next").alias("_at"), "_k", *same_values)
    come, gone = later.exceptAll(earlier).alias("a"), earlier.exceptAll(later).alias("b")
    same = (F.col("a._g") == F.col("b._g")) & (F.col("a._at") == F.col("b._at")) & F.col("a._k").eqNullSafe(F.col("b._k"))
    kind = F.when(F.col("a._g").isNull(), "removed").when(F.col("b._g").isNull(), "added").otherwise("changed")
    return come.join(gone, same, "full_outer").select(
        F.coalesce("a._g", "b._g").alias(group),
        F.coalesce("a._k", "b._k").alias(key),
        F.coalesce("a._at", "b._at").alias(snapshot_no),
        kind.alias("change_kind"),
    )
