"""Encoding a corpus with a public byte-level BPE: a table of distinct words, each encoded once, joined back by position."""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import stage

#: Where the public vocabulary lies; never copied into the repository.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The tokenizer's published word pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a block of documents; bounds what one task holds at once (a longer document is a block of its own).
BLOCK_CHARS = 1 << 20
#: Blocks of which one task gets a common word's rows; with more blocks each word's ids are sent to several tasks.
WORD_BLOCKS = 20_000
#: Token ids of a block of documents while they are decoded.
BLOCK_IDS = 1 << 18


@lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block of documents: its distinct words, the commonest first, and its documents as word numbers."""
    split = regex.compile(PATTERN).findall

    def row(ids: list, texts: list[list[str]]) -> pa.RecordBatch:
        words = [w for w, _ in Counter(w for t in texts for w in t).most_common()]
        number = {w: i for i, w in enumerate(words)}
        codes = np.fromiter((number[w] for t in texts for w in t), np.uint32)
        packed = zstandard.compress(codes.astype(np.uint16 if len(words) <= 1 << 16 else np.uint32).tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int32())), pa.array([words], pa.list_(pa.string())), pa.array([packed], pa.binary())],
            names=["ids", "lengths", "words", "codes"],
        )

    for batch in batches:
        ids, texts, chars = [], [], 0
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            if ids and chars + len(text) > BLOCK_CHARS:
                yield row(ids, texts)
                ids, texts, chars = [], [], 0
            ids.append(i)
            texts.append(split(text))
            chars += len(text)
        if ids:
            yield row(ids, texts)


def encode_corpus(df: DataFrame, row_id: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """Rows (row_id, ids): each text's token ids, without special tokens, one row for every row of `df`.

    Null and empty texts give the empty list; blank texts, odd characters and the names of special tokens are encoded like any
    other text; texts are encoded whole, at any length; repeated rows come out repeated; other columns are not read.

    Words are split once and counted within blocks of about `BLOCK_CHARS` characters, so a word travels once per block and not once
    per occurrence. The distinct words of all blocks are encoded once each; the ids go back to the blocks by (block, word), and the documents are put
    together from their word numbers.
    """
    plain = df.select(F.col(row_id).cast("bigint"), F.col(text).cast("string"))
    cut = plain.mapInArrow(blocks, "ids array<bigint>, lengths array<int>, words array<string>, codes binary")
    cut = stage(cut.withColumn("block", F.expr("uuid()")), "blocks")
    shares = cut.count() // WORD_BLOCKS + 1  # a count of the written files' rows
    share = F.pmod(F.xxhash64("block"), F.lit(shares)).cast("int")
    numbered = cut.select("block", share.alias("share"), F.posexplode("words").alias("number", "word"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks).encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(w) for w in batch.column(0).to_pylist()], pa.list_(pa.int32()))], names=["word", "pieces"])

    words = numbered.select("word", "share").distinct()
    table = words.select("word").distinct().mapInArrow(encoded, "word string, pieces array<int>")
    if shares > 1:  # else the words are their own only share
        table = words.join(table, "word")
    known = numbered.join(table, ["word", "share"] if shares > 1 else ["word"]).groupBy("block").agg(F.collect_list(F.struct("number", "pieces")).alias("known"))
    whole = cut.select("block", "ids", "lengths", "codes").join(known, "block", "left").drop("block")
    return whole.mapInArrow(assembled, "id bigint, ids array<int>").withColumnRenamed("id", row_id)


def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            ids, lengths, packed, known = (batch.column(c)[k] for c in range(4))
            n = len(known) if known.is_valid else 0
            codes = np.frombuffer(zstandard.decompress(packed.as_py()), np.uint16 if n <= 1 << 16 else np.uint32).astype(np.int64)
            if n:
                flat = known.values
                pieces, number = flat.field("pieces"), flat.field("number").to_numpy()
                offsets, values = np.asarray(pieces.offsets).astype(np.int64), pieces.values.to_numpy(zero_copy_only=False)
                start, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
                start[number], size[number] = offsets[:-1], np.diff(offsets)
                sizes = size[codes]
                ends = np.concatenate(([0], np.cumsum(sizes)))
                out = values[np.arange(ends[-1]) + np.repeat(start[codes] - ends[:-1], sizes)]
            else:
                ends, out = np.zeros(1, np.int64), np.zeros(0, np.int32)
            cuts = np.concatenate(([0], np.cumsum(lengths.values.to_numpy())))
            lists = pa.ListArray.from_arrays(pa.array(ends[cuts], pa.int32()), pa.array(out, pa.int32()))
            yield pa.RecordBatch.from_arrays([ids.values, lists], names=["id", "ids"])


def id_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block of documents: its distinct token ids, and its documents as numbers of these."""
    for batch in batches:
        lists = batch.column(1)
        size = np.asarray(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(size)))
        first = 0
        while first < len(size):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + BLOCK_IDS, "right")) - 1)
            distinct, codes = np.unique(flat[ends[first] : ends[last]], return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column(0)[first:last].to_pylist()], pa.list_(pa.int64())), pa.array([size[first:last]], pa.list_(pa.int64())), pa.array([distinct], pa.list_(pa.int32())), pa.array([zstandard.compress(codes.astype(np.uint32).tobytes())], pa.binary())],
                names=["ids", "lengths", "tokens", "codes"],
            )
            first = last


def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            ids, lengths, packed, known = (batch.column(c)[k] for c in range(4))
            pieces = {r["number"]: r["piece"] for r in known.as_py() or ()}
            table = [pieces.get(n, b"") for n in range(max(pieces, default=-1) + 1)]
            codes = np.frombuffer(zstandard.decompress(packed.as_py()), np.uint32).tolist()
            at, texts = 0, []
            for n in lengths.as_py():
                texts.append(b"".join([table[c] if c < len(table) else b"" for c in codes[at : at + n]]).decode("utf-8", "replace"))
                at += n
            yield pa.RecordBatch.from_arrays([ids.values, pa.array(texts, pa.string())], names=["id", "text"])


def pieces_of(spark: SparkSession, ranks: str) -> DataFrame:
    """Rows (token, piece) of the vocabulary."""
    e = encoder(ranks)
    return spark.createDataFrame(pa.table({"token": pa.array(range(e.n_vocab), pa.int32()), "piece": pa.array([e.decode_single_token_bytes(i) for i in range(e.n_vocab)], pa.binary())}))


def decode_corpus(df: DataFrame, row_id: str = "doc_id", ids: str = "ids", ranks: str = RANKS) -> DataFrame:
    """Rows (row_id, text) from token ids, by a join of ids and pieces. Empty lists and nulls give the empty text; ids that the vocabulary lacks and null ids give no bytes; bytes
    that are no UTF-8 become the replacement character; repeated rows come out repeated.

    An id travels once per block of about `BLOCK_IDS` ids and not once per occurrence. The pieces are as many as the vocabulary has (some 50,000, whatever the
    corpus), so they are sent to every task.
    """
    cut = df.select(F.col(row_id).cast("bigint"), F.col(ids).cast("array<int>")).mapInArrow(id_blocks, "ids array<bigint>, lengths array<bigint>, tokens array<int>, codes binary")
    cut = stage(cut.withColumn("block", F.expr("uuid()")), "id-blocks")
    numbered = cut.select("block", F.posexplode("tokens").alias("number", "token"))
    known = numbered.join(F.broadcast(pieces_of(df.sparkSession, ranks)), "token").groupBy("block").agg(F.collect_list(F.struct("number", "piece")).alias("known"))
    whole = cut.select("block", "ids", "lengths", "codes").join(known, "block", "left").drop("block")
    return whole.mapInArrow(spelled, "id bigint, text string").withColumnRenamed("id", row_id)
