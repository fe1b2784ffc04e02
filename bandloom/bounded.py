"""A membership filter of bounded size, built and probed with DataFrame functions.

The filter sets bits of a table with at most ``MOST_BLOCKS`` rows of 64 bits, so its
broadcast has a proven bound (some 20 MB).  A set bit may be a false positive, never a
false negative: it spares the shuffle of rows that certainly find no partner, and leaves
an exact join for the rest.  Past ``MOST_IDS`` ids it would let nearly everything through,
so that all rows go to the exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BLOCKS, MOST_BLOCKS = 1 << 12, 1 << 19
MOST_IDS = 8 * MOST_BLOCKS


def _place(col: Column, blocks: int) -> tuple[Column, Column]:
    h = F.xxhash64(col)
    return F.pmod(h, F.lit(blocks)).cast("int"), F.shiftright(h, 40)


def _mask(bits: Column) -> Column:
    # two bits in the block for each id
    one = F.lit(1).cast("bigint")
    a = F.call_function("shiftleft", one, F.pmod(bits, F.lit(64)).cast("int"))
    b = F.call_function("shiftleft", one, F.pmod(F.shiftright(bits, 6), F.lit(64)).cast("int"))
    return a.bitwiseOR(b)


def split_by_ids(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows of ``df`` whose key is null or certainly not among the ids, rows whose key may be).

    ``ids`` has one BIGINT column and is best a stored table: it is counted and read again.  The
    rows keep their columns, whatever their names.
    """
    n = ids.count()
    if n > MOST_IDS:
        return df.where(F.col(key).isNull()), df.where(F.col(key).isNotNull())
    if not n:
        return df, df.where(F.lit(False))
    blocks = min(MOST_BLOCKS, max(LEAST_BLOCKS, 1 << (n // 6).bit_length()))
    block, bits = _place(F.col(ids.columns[0]).cast("bigint"), blocks)
    table = ids.where(F.col(ids.columns[0]).isNotNull()).select(block.alias("block"), _mask(bits).alias("m")).groupBy("block").agg(F.bit_or("m").alias("mask"))
    block, bits = _place(F.col(key).cast("bigint"), blocks)
    joined = df.select(F.struct("*").alias("row"), block.alias("block"), _mask(bits).alias("want")).join(F.broadcast(table), "block", "left")
    hit = F.col(f"row.{key}").isNotNull() & F.coalesce(F.col("mask").bitwiseAND(F.col("want")) == F.col("want"), F.lit(False))
    return joined.where(~hit).select("row.*"), joined.where(hit).select("row.*")


#: A group with more than this share of all rows is hot; there are fewer than 4096 such groups.
HOT_SHARE = 1 / 4096


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, which has a row for each group and its number of rows in ``size``.

    The hot groups meet their rows in a broadcast of fewer than 4096 rows, the others in a
    shuffle, so that no task gets a large part of the rows.  ``groups`` is best a stored table.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) > total * HOT_SHARE
    few = F.broadcast(groups.where(hot))
    rest = rows.join(few.select(*keys), keys, "left_anti").join(groups.where(~hot), keys)
    return rows.join(few, keys).unionByName(rest)
