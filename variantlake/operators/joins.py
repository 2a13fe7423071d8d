"""Join helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side is broadcast only up to this many rows, counted beforehand.
BROADCAST_ROWS = 100_000
BLOOM_BITS, MOST_BITS, HASHES = 12, 1 << 27, 3


def held_if_small(df: DataFrame) -> tuple[DataFrame, bool]:
    """Rows that are used again, computed once: held in the plan up to ``BROADCAST_ROWS``
    rows, else as they are. Also says which."""
    rows = df.limit(BROADCAST_ROWS + 1).toArrow()
    if rows.num_rows > BROADCAST_ROWS:
        return df, False
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)), True


def may_be_in(column: str, keys: DataFrame, n: int) -> Column:
    """Whether a value may be one of about ``n`` keys (column ``column`` of ``keys``): a Bloom
    filter that the executors build, of ``BLOOM_BITS`` bits a key and ``MOST_BITS`` at most,
    whatever the keys' number. It spares a shuffle; a join decides."""
    words = min(1 << max(0, n * BLOOM_BITS // 64 - 1).bit_length(), MOST_BITS // 64)
    places = [F.pmod(F.xxhash64(F.col(column), F.lit(k)), F.lit(words * 64)) for k in range(HASHES)]
    bits = keys.select(F.explode(F.array(*places)).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p % 64))")).alias("b"))
    dense = keys.sparkSession.range(words).select(F.col("id").alias("w")).join(bits, "w", "left").select("w", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    packed = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("bits")).scalar()  # at most MOST_BITS
    hit = [F.bit_get(F.get(packed, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1 for p in places]
    return F.coalesce(hit[0] & hit[1] & hit[2], F.lit(False))

