"""A stated set of queries against all rows, block by block."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Query blocks of at most so many bytes together are broadcast; larger ones are dealt to cells.
BROADCAST_BYTES = 16 << 20
#: Row blocks that meet one query block in one cell.
CELL = 4


def against(rows: DataFrame, queries: DataFrame, size: str) -> DataFrame:
    """Each block of ``rows`` (with ``row_block`` long) beside each block of ``queries`` (with ``block``, numbers from 0, some may be
    missing; the column ``size`` holds its bytes). Both are saved tables whose records are blocks of bounded size.

    Query blocks are broadcast where their bytes were summed to be under the bound. Beyond it a row block is sent once for
    each query block, to the cell it shares with a few other row blocks; no key gets more than a cell's blocks.
    """
    last, total = queries.agg(F.coalesce(F.max("block"), F.lit(0)), F.coalesce(F.sum(size), F.lit(0))).first()
    dealt = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))
    if total <= BROADCAST_BYTES:
        return dealt.join(F.broadcast(queries), "block")
    cells = max(1, -(-rows.count() // CELL))
    dealt = dealt.withColumn("_cell", F.pmod(F.xxhash64("row_block"), F.lit(cells)))
    held = queries.withColumn("_cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
    return dealt.join(held, ["block", "_cell"]).drop("_cell").sortWithinPartitions("block")
