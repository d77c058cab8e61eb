"""Running numbers within groups of any size: no group is gathered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velum.sources.tables import saved


def numbered(df: DataFrame, groups: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """`df` with the 1-based place of each row in its group.

    Rows are range-partitioned by group and order, so a hot group spans many tasks; the rows of each (task, group)
    are counted, and a row's place is its place in the task plus the rows of its group in earlier tasks. `order` must
    decide all ties. The sorted rows are written once, since ranges are sampled anew at every evaluation.
    """
    keys = [*groups, *order]
    # as many ranges as spark.sql.shuffle.partitions, joined by their measured size where they are small
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.monotonically_increasing_id().alias("_place"))
    placed = saved(placed.withColumn("_task", F.shiftright("_place", 33)), "numbered")
    part = placed.groupBy("_task", *groups).agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(*groups).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    same = F.lit(True)
    for c in ("_task", *groups):
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}"))
    return (
        placed.alias("r").join(part.alias("p"), same)
        .select(*[F.col(f"r.{c}") for c in df.columns], (F.col("r._place") - F.col("p._first") + F.col("p._before") + 1).alias(name))
    )
