"""Records that differ only in dress (blanks, letter case, punctuation, field order): hashes over folded bytes, then verification."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import stage

#: Odd bases of the two rolling hashes (modulo 2**64).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Bytes that are folded and hashed at once.
WINDOW_BYTES = 1 << 16
#: Bits of the filter over the keys of groups for each group, and the least and most of all: 1 MB to 128 MB; with more groups it lets more rows through but loses none.
BITS_A_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 23, 1 << 30
#: Groups that hold one in so many of the rows that are in groups: so many of them at most, so they are sent to every task and their rows stay where they are.
HOT_ONE_IN = 1000
FIELDS = ("repo", "path", "name", "toolname", "version")


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """By code point: 0 for what is skipped, else the folded letter or digit (letters L*, digits Nd)."""
    table = np.zeros(0x110000, np.uint64)
    for cp in range(0x110000):
        c = chr(cp)
        if unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd"):
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


@lru_cache(maxsize=1)
def ascii_table() -> np.ndarray:
    return fold_table()[:128].astype(np.uint64)


def rolling_hashes(values: pa.Array) -> list[np.ndarray]:
    """Two 64-bit polynomial hashes of each text's letters and digits. The bytes stream through the fold table in windows of `WINDOW_BYTES`, whatever the texts' lengths: what is
    skipped adds 0 and doesn't move the power on, so no canonical text exists at any time. A null and a text without letters or digits hash alike;
    callers tell nulls apart."""
    if not pa.types.is_large_string(values.type):
        values = values.cast(pa.large_string())
    n = len(values)
    bounds = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + n + 1]
    raw = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] is not None else np.zeros(0, np.uint8)
    sums = [np.zeros(n, np.uint64) for _ in BASES]
    length = np.zeros(n, np.int64)
    row, at, end = 0, int(bounds[0]) if n else 0, int(bounds[-1]) if n else 0
    while at < end:
        stop = min(at + WINDOW_BYTES, end)
        while stop < end and raw[stop] & 0xC0 == 0x80:  # whole characters only
            stop += 1
        row = int(np.searchsorted(bounds, at, "right")) - 1
        last = int(np.searchsorted(bounds, stop, "left"))  # rows that begin in this window or before
        part = raw[at:stop]
        if (part < 0x80).all():
            codes, starts = ascii_table()[part], bounds[row:last] - at
        else:
            codes = fold_table()[np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
            before = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))  # characters before each byte
            starts = before[np.maximum(bounds[row:last] - at, 0)]
        starts = np.maximum(starts, 0)
        taken = np.concatenate(([0], np.cumsum(codes != 0)))
        own = np.diff(taken[np.append(starts, len(codes))])
        # the power at a character: what its row took before, in this window and in earlier ones
        rank = taken[:-1] + np.repeat(length[row:last] - taken[starts], np.diff(np.append(starts, len(codes))))
        for base, total in zip(BASES, sums):
            held = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * powers(base, rank), dtype=np.uint64)))
            total[row:last] += np.diff(held[np.append(starts, len(codes))])
        length[row:last] += own
        at = stop
    return [((h := total + length.astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)) ^ (h >> np.uint64(29))).view(np.int64) for total in sums]


def powers(base: int, rank: np.ndarray) -> np.ndarray:
    """base ** rank modulo 2**64, from two tables: of the low 12 bits and of the others."""
    low, high = power_tables(base, int(rank.max(initial=0)) >> 12)
    return low[rank & 4095] * high[rank >> 12]


@lru_cache(maxsize=64)
def power_tables(base: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    low = np.full(4096, base, np.uint64)
    low[0] = 1
    low = np.cumprod(low, dtype=np.uint64)
    high = np.full(most + 1, pow(base, 4096, 1 << 64), np.uint64)
    high[0] = 1
    return low, np.cumprod(high, dtype=np.uint64)


def looks_equal(a: str | None, b: str | None) -> bool:
    """Two pointers over both texts, each skipping what is neither letter nor digit."""
    if a is None or b is None:
        return a is b
    if a == b:
        return True
    fold, i, j = fold_table(), 0, 0
    while True:
        while i < len(a) and not fold[ord(a[i])]:
            i += 1
        while j < len(b) and not fold[ord(b[j])]:
            j += 1
        if i == len(a) or j == len(b):
            return i == len(a) and j == len(b)
        if fold[ord(a[i])] != fold[ord(b[j])]:
            return False
        i, j = i + 1, j + 1


def lookalikes(df: DataFrame, row_id: str, looks: list[str], exact: list[str]) -> DataFrame:
    """Rows (kept_id, copy_id) of every observation but the first of its group; a group has equal `exact` columns and
    `looks` columns with the same letters and digits in order. Copies of the kept row: one more than its rows here.

    Rows with the same `row_id` are one observation. Null equals only null, in both kinds of columns; empty texts, and texts
    without letters or digits, look the same. A null row_id is left out. Texts are hashed whole, at any length; an
    empty table gives no rows; other columns are not read.

    1. A first pass shuffles a 64-bit key and ids only (combined map-side, so a hot group costs a row per task) and leaves the keys with
       more than one id.
    2. These set bits of a filter whose size follows their number, by which the second pass drops nearly all other rows where they are read; the rest is written, with
       its texts, as the members.
    3. Members meet the first row of their group and are compared by looking at the texts themselves. The groups that hold one in `HOT_ONE_IN` of
       the members are no more than that many: their first rows go to every task, and their members stay unshuffled, so no task gets a hot group. All others are joined by key.
    4. Rows that share a hash without looking alike go through the same again among themselves.
    """
    columns = [F.col(row_id).cast("bigint").alias("id")]
    columns += [F.col(c).cast("string").alias(f"l{i}") for i, c in enumerate(looks)]
    columns += [F.col(c).cast("string").alias(f"e{i}") for i, c in enumerate(exact)]
    rows = df.filter(F.col(row_id).isNotNull()).select(*columns)
    names = rows.columns[1:]
    found: DataFrame | None = None
    while True:
        keys = keyed(rows, len(looks), len(exact)).select("key", "id")
        groups = keys.groupBy("key").agg(F.min("id").alias("kept_id"), F.max("id").alias("last"), F.count("*").alias("n")).filter("last > kept_id").drop("last")
        groups = stage(groups, "groups")
        size = groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
        members = stage(keyed(rows, len(looks), len(exact), filter_bits(groups, size["groups"])), "members")
        is_hot = F.col("n") * HOT_ONE_IN >= size["rows"]
        hot = first_rows(members, F.broadcast(groups.filter(is_hot)), names)
        cold = first_rows(members, groups.filter(~is_hot), names)
        checked = stage(compared(members, F.broadcast(hot), names, len(looks)).unionByName(compared(members, cold, names, len(looks))), "lookalikes")
        same = checked.filter("same").select("kept_id", F.col("id").alias("copy_id"))
        found = same if found is None else found.unionByName(same)
        rest = checked.filter("not same")
        if rest.isEmpty():
            return found.distinct()
        rows = rest.select("id", *names)


def filter_bits(groups: DataFrame, n: int) -> np.ndarray:
    """A bit set for each key; the number of bits is a power of two by `n`, the number of keys. The driver gets them in pieces of 4 KB, each complete."""
    bits = min(max(1 << (n * BITS_A_KEY).bit_length(), LEAST_BITS), MOST_BITS)
    place = F.pmod(F.col("key"), F.lit(bits)) + 1  # positions count from 1
    pieces = groups.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in pieces.toLocalIterator():
        out[(r["piece"] - 1) * 4096 : r["piece"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def first_rows(members: DataFrame, groups: DataFrame, names: list[str]) -> DataFrame:
    """The texts of the first row of each group; rows with one id are one observation, of which any is taken."""
    return members.withColumnRenamed("id", "kept_id").join(groups.select("key", "kept_id"), ["key", "kept_id"]).groupBy("key", "kept_id").agg(*(F.first(c).alias(f"kept_{c}") for c in names))


def keyed(df: DataFrame, looks: int, exact: int, bits: np.ndarray | None = None) -> DataFrame:
    """`df` with the 64-bit key of each row; given filter bits, only the rows whose bit is set."""
    names = df.columns
    first = 1 + looks
    sent = None if bits is None else df.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.zeros(batch.num_rows, np.uint64)
            for i in range(looks):
                one, two = rolling_hashes(batch.column(1 + i))
                null = batch.column(1 + i).is_null().to_numpy(zero_copy_only=False)
                key = mixed(key, np.where(null, np.int64(-1), one ^ (two << 1)).view(np.uint64))
            key = mixed(key, batch.column(first + exact).to_numpy(zero_copy_only=False).view(np.uint64)).view(np.int64)
            batch = pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(first + exact)), pa.array(key)], names=[*names, "key"])
            if sent is not None:
                place = key % (len(sent.value) * 8)
                batch = batch.filter(pa.array((sent.value[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)))
            yield batch

    texts = [F.col(f"e{i}") for i in range(exact)]
    code = F.xxhash64(F.lit(1), *(c.isNull() for c in texts), *texts)
    schema = "".join(f"{c} {kind}, " for c, kind in df.dtypes) + "key bigint"
    return df.withColumn("code", code).mapInArrow(run, schema)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(BASES[0])) ^ b
    return (x ^ (x >> np.uint64(31))) * np.uint64(BASES[1])


def compared(members: DataFrame, firsts: DataFrame, names: list[str], looks: int) -> DataFrame:
    """Members of groups but for the first ones, and whether they are the first one's copies."""
    equal = F.lit(True)
    for c in names[looks:]:
        equal = equal & F.col(c).eqNullSafe(F.col(f"kept_{c}"))
    pairs = members.join(firsts, "key").filter("id <> kept_id").select("id", *names, "kept_id", *(f"kept_{c}" for c in names[:looks]), equal.alias("equal"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            same = batch.column(at["equal"]).to_pylist()
            for c in names[:looks]:
                a, b = batch.column(at[c]).to_pylist(), batch.column(at[f"kept_{c}"]).to_pylist()
                same = [s and looks_equal(x, y) for s, x, y in zip(same, a, b)]
            out = [batch.column(at[c]) for c in ("id", *names, "kept_id")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(same, pa.bool_())], names=["id", *names, "kept_id", "same"])

    schema = "id bigint, " + "".join(f"{c} string, " for c in names) + "kept_id bigint, same boolean"
    return pairs.mapInArrow(run, schema)


def parse_record(payload: str | None) -> dict[str, str] | None:
    """The five fields of a payload, keys by looks: a JSON object, `key=value` parted by `;`, or `key: value` parted by `|` or line ends.
    None where it is no whole record. A piece without a known key belongs to the value before it."""
    if payload is None:
        return None
    text = payload.strip()
    if text.startswith("{"):
        try:
            whole = json.loads(text)
        except ValueError:
            return None
        if not isinstance(whole, dict):
            return None
        fields = {known_key(k): "" if v is None else v if isinstance(v, str) else json.dumps(v) for k, v in whole.items()}
    else:
        best: dict[str, str] = {}
        for cut, mark in ((";", "="), ("|", ":"), (r"\r\n|\n|\r", ":")):
            fields, last = {}, ""
            for piece in re.split(cut if len(cut) > 1 else re.escape(cut), payload):
                key, is_pair, value = piece.partition(mark)
                known = known_key(key) if is_pair else ""
                if known and known not in fields:
                    fields[known], last = value, known
                elif last:
                    fields[last] += (cut if len(cut) == 1 else "\n") + piece
            best = max(best, fields, key=len)
        fields = best
    fields.pop("", None)
    return {k: v.strip() if k in ("repo", "path", "version") else v for k, v in fields.items()} if len(fields) == len(FIELDS) else None


@lru_cache(maxsize=4096)
def known_key(key: str) -> str:
    looks = "".join(c for c in key if c.isalnum()).lower()
    return looks if looks in FIELDS else ""


def parsed_records(df: DataFrame, row_id: str = "record_id", payload: str = "payload") -> DataFrame:
    """Rows (id, repo, path, name, tool_name, version) of the payloads that are whole records; a missing value is empty. Null, empty and
    cut-off payloads give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = [(i, r) for i, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (r := parse_record(p)) is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in records], pa.int64()), *(pa.array([r[f] for _, r in records], pa.string()) for f in FIELDS)],
                names=["id", "repo", "path", "name", "tool_name", "version"],
            )

    return df.select(F.col(row_id).cast("bigint"), F.col(payload).cast("string")).mapInArrow(run, "id bigint, repo string, path string, name string, tool_name string, version string")
