"""Changes between consecutive full snapshots of a table.

Method: each snapshot is reduced to its valid row per key, identical rows are removed with EXCEPT ALL in both
directions, and the residues are joined in full by key to tell additions, removals and changes.  All pairs of
consecutive snapshots go through one plan; nothing loops on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_state(text: Column) -> Column:
    """Digest of a text in which white space at line ends and at the end of the text, and null against empty, don't count."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s&&[^\n]]+(?=\n)", "")
    trimmed = F.regexp_replace(trimmed, r"(?U)\s+$", "")
    return F.unhex(F.sha2(trimmed, 256))


def snapshot_changes(rows: DataFrame, number: str, key: str, state: list[str], last_by: list[str]) -> DataFrame:
    """Rows ``(number, key, change_kind)`` for every snapshot but the lowest.

    ``rows``: any number of rows per snapshot and key; the one with the greatest ``last_by`` holds.  ``state``: the
    columns whose difference is a change; nulls in them are values.  Nulls in ``last_by`` sort first; full ties fall
    to the greater state, so repeated rows never matter.  Rows with a null number or key can't be compared and yield
    nothing; an empty table yields an empty result; other columns are ignored.
    """
    packed = F.struct(*[F.col(c) for c in state])
    valid = (
        rows.where(F.col(number).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(number).alias("_no"), F.col(key).alias("_key"))
        .agg(F.max(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(last_by)], packed.alias("_state"))).alias("_m"))
        .select("_no", "_key", *[F.col(f"_m._state.{c}").alias(f"_s{i}") for i, c in enumerate(state)])
    )
    # One row per snapshot number: a window over a table as long as the number of snapshots taken.
    order = Window.orderBy("_no")
    numbers = rows.where(F.col(number).isNotNull() & F.col(key).isNotNull()).select(F.col(number).alias("_no")).distinct()
    pairs = numbers.withColumn("_before", F.lag("_no").over(order)).where("_before is not null")
    cols = ["_no", "_key", *[f"_s{i}" for i in range(len(state))]]
    now = valid.join(pairs.select("_no"), "_no", "left_semi").select(cols)
    before = valid.withColumnRenamed("_no", "_before").join(pairs, "_before").select(cols)
    came, went = now.exceptAll(before), before.exceptAll(now)
    kind = F.when(F.col("_gone").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    return (
        came.select("_no", "_key", F.lit(True).alias("_new"))
        .join(went.select("_no", "_key", F.lit(True).alias("_gone")), ["_no", "_key"], "full")
        .select(F.col("_no").alias(number), F.col("_key").alias(key), kind.alias("change_kind"))
    )
