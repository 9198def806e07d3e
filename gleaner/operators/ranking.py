"""Top-n per group and global numbering that hold up when one group is huge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import cut_lineage

# Up to here the cut Spark makes inside each map task leaves few enough rows of a hot group for one task.
GROUP_LIMIT = 100
SALTS = 64


def _columns(order: str | Column | list) -> list[Column]:
    listed = order if isinstance(order, (list, tuple)) else [order]
    return [F.col(item) if isinstance(item, str) else item for item in listed]


def top_n(df: DataFrame, keys: str | list[str], order, n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows of every group by ``order``; ``rank`` names an optional position column.

    Small ``n``: the window's limit runs map-side first, so a hot group ships at most ``n`` rows per task.
    Large ``n``: a salted pass spreads each hot group over many tasks before the final pass.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    ordering = _columns(order)
    position = rank or "_position"
    if n > GROUP_LIMIT:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*ordering), F.lit(SALTS)))
        inner = Window.partitionBy(*keys, "_salt").orderBy(*ordering)
        df = salted.withColumn("_inner", F.row_number().over(inner)).filter(F.col("_inner") <= n).drop("_inner", "_salt")
    window = Window.partitionBy(*keys).orderBy(*ordering)
    ranked = df.withColumn(position, F.row_number().over(window)).filter(F.col(position) <= n)
    return ranked if rank else ranked.drop(position)


def global_position(df: DataFrame, order, name: str) -> DataFrame:
    """Number all rows 1..n in order without gathering them in one task.

    Range partitions are sorted and written once; each learns how many rows lie before it.
    """
    # Equal order keys are spread by the row's hash, so one frequent key does not fill one partition.
    hashable = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant", "struct", "array")]
    ordering = [*_columns(order), *([F.xxhash64(*hashable)] if hashable else [])]
    placed = cut_lineage(
        df.repartitionByRange(*ordering).withColumn("_part", F.spark_partition_id())
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    # One row per partition, so this window stays small however large the frame is.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*ordering))
    numbered = placed.withColumn("_inside", inside).join(offsets, "_part")
    return numbered.withColumn(name, F.col("_before") + F.col("_inside")).drop("_part", "_before", "_inside")
