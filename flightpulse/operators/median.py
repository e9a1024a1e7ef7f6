"""Exact upper median from a histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Values are walked in blocks of 2^16. Delays between two timestamps of the
# years 1 to 9999 span less than 2^34 minutes, so there are fewer than 2^18
# blocks and 2^16 values in one: both ordered walks below are bounded.
BLOCK_BITS = 16


def upper_median(histogram: DataFrame, value: str, count: str) -> DataFrame:
    """One row: the element at position ``n div 2`` (0-based) of the sorted values.

    For an even number of values this is the larger of the two middle ones.
    First the block that holds the position is found from block totals, then
    only the values of this block are walked.
    """
    block = F.shiftright(F.col(value), BLOCK_BITS)
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_block").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    holder = (
        histogram.groupBy(block.alias("_block"))
        .agg(F.sum(count).alias("_in_block"))
        .select(
            "_block",
            "_in_block",
            F.coalesce(F.sum("_in_block").over(earlier), F.lit(0)).alias("_before"),
            F.call_function("div", F.sum("_in_block").over(everything), F.lit(2)).alias("_position"),
        )
        .where("_position >= _before AND _position < _before + _in_block")
    )
    upto = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        # ``holder`` has one row at most, which bounds the broadcast. Null-safe
        # equality adds no filter to one use of the histogram only, so that its
        # shuffle serves every use.
        histogram.join(F.broadcast(holder), block.eqNullSafe(F.col("_block")))
        .select(value, (F.col("_before") + F.sum(count).over(upto)).alias("_upto"), "_position")
        .where("_upto > _position")
        .agg(F.min(value).alias(value))
    )
