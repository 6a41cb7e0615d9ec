"""Joins against per-group tables and the spread of costly work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelab.session import settle

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def attach(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left",
           broadcast_rows: int = BROADCAST_ROWS, settled: bool = False,
           broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join a per-group table back onto its rows.

    The table is computed once and measured. Up to broadcast_rows and broadcast_bytes (of its rows as text)
    it is broadcast, so the rows are not shuffled and a hot group stays spread over its scan tasks. A larger
    table takes part in an ordinary join, whose skewed partitions adaptive execution splits.
    """
    table = table if settled else settle(table)
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns])))
    count, size = table.select(width.alias("width")).agg(F.count(F.lit(1)), F.coalesce(F.sum("width"), F.lit(0))).first()
    if count <= broadcast_rows and size <= broadcast_bytes:
        table = F.broadcast(table)
    return rows.join(table, list(keys), how)


def fan_out(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle by keys into all shuffle partitions, for costly work per row or group downstream.

    The shuffle is the one the following join or grouping on the same keys needs anyway; the stated
    number only keeps adaptive execution from merging partitions that are small in bytes but not in work.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def fill_cores(scan: DataFrame) -> DataFrame:
    """Spread the rows of a scan that has fewer tasks than there are cores; larger scans stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
