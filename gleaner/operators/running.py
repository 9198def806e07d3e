"""Running totals inside keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import write_table


def running_before(rows: DataFrame, key: str, order: list[Column], totals: dict[str, tuple[str, str, int]]) -> DataFrame:
    """Add columns that total the earlier rows of the same key: name to function (``count``, ``sum``, ``bit_xor``), column and start.

    Rows are range partitioned by key and order, so a key with most of the rows spreads over many partitions. Each partition totals
    its own rows in one ordered pass; keys that cross a border then get what the partitions before it held. These carries have at most
    two rows a partition, whatever the size of the table. The partitions are written once, as the carries must see the same ones.
    """
    combine = {"count": "sum", "sum": "sum", "bit_xor": "bit_xor"}
    placed = write_table(rows.repartitionByRange(F.col(key).asc_nulls_first(), *order).withColumn("_part", F.spark_partition_id()))
    calls = {name: F.call_function(how, F.col(column)) for name, (how, column, _) in totals.items()}
    inside = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    held = placed.groupBy(key, "_part").agg(*[call.alias(name) for name, call in calls.items()])
    # Only keys in several partitions carry anything; a partition has at most one from before and one that goes on.
    borders = held.groupBy(key).agg(F.count(F.lit(1)).alias("_parts")).where("_parts > 1").select(F.col(key).alias("_carry_key"))
    crossing = held.join(borders, F.col(key).eqNullSafe(F.col("_carry_key")), "left_semi")
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = crossing.select(
        F.col(key).alias("_carry_key"), F.col("_part").alias("_carry_part"),
        *[F.call_function(combine[how], F.col(name)).over(earlier).alias(f"_before_{name}") for name, (how, _, _) in totals.items()],
    )
    run = placed.withColumns({name: call.over(inside) for name, call in calls.items()})
    joined = run.join(carried, F.col(key).eqNullSafe(F.col("_carry_key")) & (F.col("_part") == F.col("_carry_part")), "left")
    sums = {}
    for name, (how, _, start) in totals.items():
        here, before = F.coalesce(F.col(name), F.lit(start).cast("long")), F.coalesce(F.col(f"_before_{name}"), F.lit(start).cast("long"))
        sums[name] = here.bitwiseXOR(before) if how == "bit_xor" else here + before
    return joined.withColumns(sums).drop("_part", "_carry_key", "_carry_part", *[f"_before_{name}" for name in totals])
