"""Running values of a key of any size: prefix scans in two passes over range partitions.

A window over one key puts all its rows in one task. Here rows are dealt by ranges of (key, order), so a key may cover many
chunks; each chunk is scanned alone and written, one row a chunk says what the chunk does to whatever came before it, and
those few rows, combined in order, give each chunk what to start from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import checkpointed

Rows = Callable[[DataFrame, WindowSpec], DataFrame]


def prefix_scan(rows: DataFrame, key: list[str], order: list[str], local: Rows, totals: list[Column], carry: Rows, chunks: int | None = None) -> DataFrame:
    """rows with the columns that `local` adds (running values within a chunk) and those that `carry` adds (what all
    earlier chunks of the key come to; null in a key's first chunk).

    `local` gets the rows and the window of a key's rows of a chunk up to the current one; `totals` are a chunk's
    aggregates; `carry` gets them, by key and chunk, and the window of a key's earlier chunks. `order` should leave no ties
    within a key. A chunk holds the middle of two keys at most, so the keys that have a second chunk have two rows a chunk
    in all: that bounds what is combined and broadcast, whatever the number of rows or keys. Null keys are keys.
    """
    n = chunks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *key, *order).withColumn("_chunk", F.spark_partition_id())
    within = Window.partitionBy(*key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    told = checkpointed(local(dealt, within))
    sums = told.groupBy(*key, "_chunk").agg(*totals)
    spread = sums.withColumn("_n", F.count("*").over(Window.partitionBy(*key))).where("_n > 1").drop("_n")
    before = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    known = set(told.columns)
    made = carry(spread, before)
    added = [c for c in made.columns if c not in known and c not in sums.columns]
    small = made.select(*[F.col(c).alias(f"_of_{c}") for c in [*key, "_chunk"]], *added)
    meet = F.lit(True)
    for c in [*key, "_chunk"]:
        meet &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return told.join(F.broadcast(small), meet, "left").drop(*[f"_of_{c}" for c in [*key, "_chunk"]], "_chunk")


def running_sum(rows: DataFrame, key: list[str], order: list[str], value: Column, name: str, chunks: int | None = None) -> DataFrame:
    """rows with `name`: the sum of value over a key's rows up to the current one."""
    out = prefix_scan(
        rows, key, order, lambda df, w: df.withColumn("_v", value).withColumn("_s", F.sum("_v").over(w)), [F.sum("_v").alias("_t")], lambda df, w: df.withColumn("_s0", F.sum("_t").over(w)), chunks
    )
    return out.withColumn(name, F.col("_s") + F.coalesce("_s0", F.lit(0))).drop("_v", "_s", "_s0")


def floored_sum(rows: DataFrame, key: list[str], order: list[str], value: Column, name: str, chunks: int | None = None) -> DataFrame:
    """rows with `name`: a counter that adds value and never falls below 0.

    It is the running sum less its least prefix (0 at most). A chunk is its (sum, least prefix): what follows it starts
    from the sum of the sums, and the least of each chunk's prefix on top of the sums before it.
    """

    def carry(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumn("_s0", F.sum("_t").over(w)).withColumn("_low", F.coalesce("_s0", F.lit(0)) + F.col("_lt")).withColumn("_m0", F.min("_low").over(w)).drop("_low")

    local = lambda df, w: df.withColumn("_v", value).withColumn("_s", F.sum("_v").over(w)).withColumn("_m", F.min("_s").over(w))
    out = prefix_scan(rows, key, order, local, [F.sum("_v").alias("_t"), F.min("_m").alias("_lt")], carry, chunks)
    base = F.coalesce("_s0", F.lit(0))
    return out.withColumn(name, base + F.col("_s") - F.least(F.lit(0), F.coalesce("_m0", F.lit(0)), base + F.col("_m"))).drop("_v", "_s", "_m", "_s0", "_m0")


def count_since(rows: DataFrame, key: list[str], order: list[str], counted: Column, reset: Column, name: str, chunks: int | None = None) -> DataFrame:
    """rows with `name`: how many counted rows a key has had since its last reset row. A reset row itself has 0."""

    def local(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumn("_s", F.count_if(counted).over(w)).withColumn("_r", reset).withColumn("_l", F.max(F.when(F.col("_r"), F.col("_s"))).over(w))

    def carry(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumn("_s0", F.sum("_t").over(w)).withColumn("_at", F.coalesce("_s0", F.lit(0)) + F.col("_lt")).withColumn("_l0", F.max("_at").over(w)).drop("_at")

    out = prefix_scan(rows, key, order, local, [F.max("_s").alias("_t"), F.max("_l").alias("_lt")], carry, chunks)
    base = F.coalesce("_s0", F.lit(0))
    return out.withColumn(name, base + F.col("_s") - F.coalesce(F.greatest(base + F.col("_l"), F.col("_l0")), F.lit(0))).drop("_s", "_r", "_l", "_s0", "_l0")


def moving_average(rows: DataFrame, key: list[str], order: list[str], value: str, name: str, keep: float = 0.9, chunks: int | None = None) -> DataFrame:
    """rows with `name`: the exponential average keep * average + (1 - keep) * value, from 0, over all of a key's rows.

    A row is the map x -> keep x + (1 - keep) value, and a chunk of n rows the map x -> keep^n x + b, with b its own
    average from 0: maps that compose, so a chunk needs one pass and no row a list. A null value leaves the average.
    """
    rest = round(1 - keep, 12)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, x, a = object(), 0.0, 1.0
        for pdf in batches:
            average, power = [], []
            for k, v in zip(zip(*[pdf[c].astype(object).where(pdf[c].notna(), None) for c in key]), pdf[value]):
                if k != last:
                    last, x, a = k, 0.0, 1.0
                if v == v and v is not None:
                    x, a = keep * x + rest * float(v), keep * a
                average.append(x)
                power.append(a)
            yield pdf.assign(_x=average, _a=power)

    def local(df: DataFrame, _: WindowSpec) -> DataFrame:  # a chunk is a partition, and streams in order
        return df.sortWithinPartitions(*key, *order).mapInPandas(run, f"{_ddl(df)}, _x double, _a double")

    def combined(pdf: pd.DataFrame) -> pd.DataFrame:
        x, before = 0.0, []
        pdf = pdf.sort_values("_chunk")
        for a, b in zip(pdf["_at"], pdf["_xt"]):
            before.append(x)
            x = a * x + b
        return pdf.assign(_x0=before)

    def carry(df: DataFrame, _: WindowSpec) -> DataFrame:
        return df.groupBy(*key).applyInPandas(combined, f"{_ddl(df)}, _x0 double")

    last = [F.max_by(c, F.struct(*order)).alias(f"{c}t") for c in ("_a", "_x")]
    out = prefix_scan(rows, key, order, local, last, carry, chunks)
    return out.withColumn(name, F.col("_a") * F.coalesce("_x0", F.lit(0.0)) + F.col("_x")).drop("_x", "_a", "_x0")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
