"""Items that appear together: a blocked Gram matrix of the sparse binary basket x item matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import stage

#: Frequent items, of all groups together, that are sent to every task; more are joined by a shuffle.
SENT = 200_000
#: Items of a block, blocks of counts that a task holds before it hands them on, and cells of sparse products added up at once.
BLOCK = 256
HELD = 64
CELLS = 1 << 22


def pair_counts(baskets: DataFrame, group: str | None, basket: list[str], item: str, min_count: int, one_in: int, block: int = BLOCK) -> DataFrame:
    """Rows (group, item_a, item_b, n_ab, n_a, n_b, n_baskets, lift), item_a < item_b by code points, of every pair of items that
    at least `min_count` baskets and one in `one_in` of the group's baskets hold; lift is n_ab * N / (n_a * n_b). Without `group` all
    baskets are one group, "all".

    A basket is the set of its distinct non-null items: repeated rows change nothing, null items are left out, an empty
    string is an item like any other; null basket keys form a basket of their own, and so do null groups; a basket without items counts
    nowhere. An empty table gives no rows.

    1. The baskets of each group are counted, by their keys, and the rows of each item, both combined map-side. A pair can't be in more baskets than
       its items have rows, so items with fewer rows than both limits ask for are left out before any basket is put together, which loses nothing. The
       others are few: no more than `one_in` times the mean rows of a basket.
    2. The rows of these items become codes, and baskets sparse binary rows of codes, as sets that are combined map-side: a hot basket or item sends each task's set
       of codes, not its rows.
    3. A task sums the products X_i' X_j of its record blocks for each pair of item blocks that occurs, and hands on sums, never pairs of rows. The diagonal
       of the sum is what each item alone has.
    """
    names = [f"b{i}" for i in range(len(basket))]
    label = F.col(group).cast("string") if group else F.substring(F.col(item).cast("string"), 1, 0)  # no constant, which would make joins nested loops
    # a null-safe text key: joins by equality keep their hash partitioning and need no null-safe condition
    key = F.concat(F.when(label.isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(label, F.lit("")))
    rows = baskets.filter(F.col(item).isNotNull()).select(key.alias("g"), *(F.col(c).alias(n) for c, n in zip(basket, names)), F.col(item).cast("string").alias("item"))
    sizes = rows.select("g", *names).distinct().groupBy("g").agg(F.count("*").alias("n_baskets"))
    counts = rows.groupBy("g", "item").agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") >= min_count)
    often = counts.join(sizes, "g").filter(F.col("n_rows") * one_in >= F.col("n_baskets")).select("g", "item", "n_baskets")
    often = stage(often.withColumn("code", F.row_number().over(Window.partitionBy("g").orderBy("item")) - 1), "items")
    codes = often.select("g", "item", "code")
    sparse = rows.join(F.broadcast(codes) if often.count() <= SENT else codes, ["g", "item"]).groupBy("g", *names).agg(F.collect_set("code").alias("codes")).select("g", "codes")
    sums = stage(
        sparse.mapInArrow(lambda batches: gram(batches, block), "g string, a int, b int, n bigint")
        .groupBy("g", "a", "b")
        .agg(F.sum("n").alias("n_ab"))
        .filter(F.col("n_ab") >= min_count),
        "sums",
    )
    alone = sums.filter("a = b").select("g", F.col("a").alias("code"), F.col("n_ab").alias("n")).join(often, ["g", "code"])
    x, y = (alone.select("g", F.col("code").alias(c), F.col("item").alias(f"item_{c}"), F.col("n").alias(f"n_{c}"), *(["n_baskets"] if c == "a" else [])) for c in "ab")
    name = F.lit("all") if not group else F.when(F.col("g").startswith("1"), F.expr("substring(g, 2)"))
    return (
        sums.filter("a < b")
        .join(x, ["g", "a"])
        .filter(F.col("n_ab") * one_in >= F.col("n_baskets"))
        .join(y, ["g", "b"])
        .select(name.alias("group"), "item_a", "item_b", "n_ab", "n_a", "n_b", "n_baskets", (F.col("n_ab") * F.col("n_baskets") / (F.col("n_a") * F.col("n_b"))).alias("lift"))
    )


def gram(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Sums of transpose-products of this task's baskets, one matrix for each (group, item block, item block) that occurs."""
    held: dict[tuple[str, int, int], np.ndarray] = {}
    for batch in batches:
        groups = np.array(batch.column(0).to_pylist(), dtype=object)
        lists = batch.column(1)
        ends = np.asarray(lists.offsets)
        codes = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
        for g in dict.fromkeys(groups):
            rows = np.flatnonzero(groups == g)
            n = ends[rows + 1] - ends[rows]
            row = np.repeat(np.arange(len(rows)), n)
            code = codes[np.repeat(ends[rows] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
            blocks = {int(i): sparse_block(row, code, i, block, len(rows)) for i in np.unique(code // block)}
            for i, x in blocks.items():
                for j, y in blocks.items():
                    if i <= j:
                        product = transpose_product(x, y, block)
                        own = (g, i, j)
                        held[own] = held[own] + product if own in held else product
            if len(held) > HELD:
                yield from cells(held, block)
                held = {}
    yield from cells(held, block)


def sparse_block(row: np.ndarray, code: np.ndarray, i: int, block: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns of one item block as a sparse binary matrix: where each row starts, and the columns of its ones."""
    own = code // block == i
    return np.concatenate(([0], np.cumsum(np.bincount(row[own], minlength=rows)))), code[own] % block


def transpose_product(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], block: int) -> np.ndarray:
    """X'Y of two sparse binary matrices with the same rows: the sum over rows of their outer products, some rows at a time."""
    (xs, xc), (ys, yc) = x, y
    nx, ny = np.diff(xs), np.diff(ys)
    work = np.concatenate(([0], np.cumsum(nx * ny)))
    out = np.zeros(block * block, np.int64)
    first = 0
    while first < len(nx):
        last = max(first + 1, int(np.searchsorted(work, work[first] + CELLS, "right")) - 1)
        a = np.arange(xs[first], xs[last])  # each one of X meets all ones of its row in Y
        per = np.repeat(ny[first:last], nx[first:last])
        left = np.repeat(xc[a], per)
        begin = np.repeat(np.repeat(ys[first:last], nx[first:last]), per)
        right = yc[begin + np.arange(len(left)) - np.repeat(np.cumsum(per) - per, per)]
        out += np.bincount(left * block + right, minlength=block * block)
        first = last
    return out.reshape(block, block)


def cells(held: dict[tuple[str, int, int], np.ndarray], block: int) -> Iterator[pa.RecordBatch]:
    """The cells of the sums, on and above the diagonal."""
    for (g, i, j), m in held.items():
        a, b = np.nonzero(np.triu(m) if i == j else m)
        if len(a):
            yield pa.RecordBatch.from_arrays(
                [pa.array([g] * len(a), pa.string()), pa.array(a + i * block, pa.int32()), pa.array(b + j * block, pa.int32()), pa.array(m[a, b], pa.int64())],
                names=["g", "a", "b", "n"],
            )
