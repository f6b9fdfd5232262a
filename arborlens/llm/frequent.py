"""Most frequent values in bounded memory: iceberg filtering with several hashes, then exact counts of the survivors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashes and buckets of the coarse counts: HASHES * BUCKETS counters, whatever the input.
HASHES = 3
BUCKETS = 1 << 14


def frequent_values(df: DataFrame, columns: list[str], one_in: dict[str, int], hashes: int = HASHES, buckets: int = BUCKETS) -> DataFrame:
    """Rows (field, item, n, total) of every value of each of `columns` that at least one in `one_in[column]` of the
    column's rows holds. Counts are exact and no value is missed.

    Rows whose value is null or the empty string are neither counted nor part of `total`. Values are compared exactly
    (letter case, blanks, length). Ties at the threshold all come out; an empty table gives no rows; other columns
    are not read.

    1. one pass counts, for every column and each of several hashes, the rows per bucket: `hashes * buckets` exact
       counters per column, combined map-side, so the shuffle holds counters and never values;
    2. at most `one_in` buckets per hash can reach the threshold: these are the only thing the driver sees;
    3. a value is a candidate only where all its buckets reached the threshold (no false negatives: a bucket's count is
       no less than that of any value in it); the survivors are counted exactly, map-side first.
    """
    cells = F.explode(
        F.array(
            *(
                F.struct(F.lit(i).alias("field"), F.lit(h).alias("hash"), F.when(present(c), bucket(c, h, buckets)).alias("bucket"))
                for i, c in enumerate(columns)
                for h in range(hashes)
            )
        )
    )
    counts = df.select(*columns).select(cells.alias("c")).select("c.*").filter("bucket is not null").groupBy("field", "hash", "bucket").agg(F.count("*").alias("n"))
    # every hash sees every counted row, so the first gives the total
    totals = counts.groupBy("field").agg(F.sum(F.when(F.col("hash") == 0, F.col("n"))).alias("total"))
    shares = F.element_at(F.array(*(F.lit(one_in[c]) for c in columns)), F.col("field") + 1)
    heavy: dict[tuple[int, int], list[int]] = {}
    sums: dict[int, int] = {}
    for r in counts.join(F.broadcast(totals), "field").filter(F.col("n") * shares >= F.col("total")).collect():
        heavy.setdefault((r["field"], r["hash"]), []).append(r["bucket"])
        sums[r["field"]] = r["total"]
    kept = F.array(
        *(
            F.when(
                F.forall(F.array(*(bucket(c, h, buckets).isin(heavy.get((i, h), [-1])) for h in range(hashes))), lambda x: x) & present(c),
                F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("item")),
            )
            for i, c in enumerate(columns)
        )
    )
    total = F.create_map(*(F.lit(x) for i, c in enumerate(columns) for x in (c, sums.get(i, 0))))
    least = F.create_map(*(F.lit(x) for i, c in enumerate(columns) for x in (c, max(1, math.ceil(sums.get(i, 0) / one_in[c])))))
    return (
        df.select(*columns)
        .select(F.explode(F.array_compact(kept)).alias("c"))
        .groupBy("c.field", "c.item")
        .agg(F.count("*").alias("n"))
        .withColumn("total", total[F.col("field")].cast("bigint"))
        .filter(F.col("n") >= least[F.col("field")])
    )


def present(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def bucket(c: str, seed: int, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(c)), F.lit(buckets)).cast("int")
