"""Evaluation passages in a corpus: SimHash of item-sized windows with multi-index Hamming blocks, a shingle index for near matches beyond the radius,
exact verification."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import stage

#: A passage is so many words, or the whole item where it has fewer.
WINDOW = 13
#: Fingerprints within RADIUS of 64 bits agree on at least one of RADIUS + 1 blocks. Windows that are SIMILARITY alike differ in 7 bits on average and in up to
#: 18, where blocks tell nothing apart; those beyond the radius come from the shingle index.
RADIUS = 3
SHINGLE = 5
SIMILARITY = 0.8
#: Words of the items held by a task at once; more items are taken in several passes.
ITEM_WORDS = 2_000_000
#: Words of documents fingerprinted at once.
CHUNK = 16_384
#: (window, shingle, passage) looked at at once.
HITS = 4_000_000

WORD = regex.compile(r"[\p{L}\p{N}]+")


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    return [w.lower() for w in WORD.findall(text)] if text else []


def signs(hashes: np.ndarray) -> np.ndarray:
    """A row of 64 values +1 or -1 for each word, from its hash."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int8) * 2 - 1


def word_hashes(vocabulary: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in vocabulary], np.uint64)


def shingle_hashes(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Of every run of `size` words along the last axis, from the words' hashes; in order."""
    n = hashes.shape[-1] - size + 1
    out = np.zeros((*hashes.shape[:-1], n), np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[..., k : k + n]
    return out


def run_sums(values: np.ndarray, size: int) -> np.ndarray:
    """Sums of every run of `size` values along the last axis."""
    sums = np.zeros((*values.shape[:-1], values.shape[-1] + 1), np.int64)
    np.cumsum(values, axis=-1, out=sums[..., 1:])
    return sums[..., size:] - sums[..., :-size]


def fingerprints(totals: np.ndarray) -> np.ndarray:
    """SimHash of windows, from the sums of their words' signs."""
    return np.packbits(totals > 0, axis=1).view(np.uint64).ravel()


class Passages:
    """The windows of the evaluation items, looked up by fingerprint."""

    def __init__(self, items: list[tuple[int, str | None]], window: int, radius: int):
        self.radius = radius
        owners: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for i, text in items:
            w = words(text)
            size = min(window, len(w))
            for at in range(len(w) - size + 1 if size else 0):
                own = owners[tuple(w[at : at + size])]
                if i not in own[-1:]:
                    own.append(i)
        self.passages = list(owners)
        self.owners = [list(dict.fromkeys(o)) for o in owners.values()]
        self.sizes = sorted({len(p) for p in self.passages})
        self.of_size = {s: [k for k, p in enumerate(self.passages) if len(p) == s] for s in self.sizes}
        self.tables, self.shingles = {}, {}
        cuts = np.linspace(0, 64, radius + 2).astype(int)
        self.cuts = [(int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:])]
        for s, own in self.of_size.items():
            vocabulary = sorted({w for k in own for w in self.passages[k]})
            number = {w: i for i, w in enumerate(vocabulary)}
            index = np.array([[number[w] for w in self.passages[k]] for k in own])
            hashes = word_hashes(vocabulary)
            sign = signs(hashes)
            totals = np.zeros((len(own), 64), np.int32)
            for c in range(s):
                totals += sign[index[:, c]]
            prints = fingerprints(totals)
            blocks = []
            for a, b in self.cuts:
                key = (prints >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
                order = np.argsort(key, kind="stable")
                starts = np.searchsorted(key[order], np.arange((1 << (b - a)) + 1))
                blocks.append((order, starts))
            self.tables[s] = (np.array(own), prints, blocks)
            if s > SHINGLE:  # shorter windows are alike only if they are equal
                own_shingles = shingle_hashes(hashes[index])
                letters = run_sums(np.array([len(w) for w in vocabulary])[index], SHINGLE).sum(1)
                order = np.argsort(own_shingles, axis=None, kind="stable")
                rows = (order // own_shingles.shape[1]).astype(np.int32)
                flat = own_shingles.ravel()[order]
                first = np.r_[True, (flat[1:] != flat[:-1]) | (rows[1:] != rows[:-1])]  # a shingle counts once in a passage
                flat, rows = flat[first], rows[first]
                known_shingles, starts = np.unique(flat, return_index=True)
                self.shingles[s] = (known_shingles, np.r_[starts, len(flat)], rows, letters)
        self.every_shingle = np.unique(np.concatenate([known for known, *_ in self.shingles.values()])) if self.shingles else np.zeros(0, np.uint64)

    def candidates(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, passage) for all fingerprints within the radius."""
        own, known, blocks = self.tables[size]
        found = []
        for (a, b), (order, starts) in zip(self.cuts, blocks):
            key = ((prints >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)).astype(np.int64)
            first = starts[key]
            count = starts[key + 1] - first
            hit = np.flatnonzero(count)
            if len(hit):
                n = count[hit]
                w = np.repeat(hit, n)
                k = order[np.repeat(first[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                near = np.bitwise_count(prints[w] ^ known[k]) <= self.radius
                found.append(w[near] * len(known) + k[near])
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return both // len(known), own[both % len(known)]

    def met(self, shingles: np.ndarray) -> np.ndarray:
        """Places of the shingles that any passage has."""
        if not len(self.every_shingle) or not len(shingles):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.every_shingle, shingles), len(self.every_shingle) - 1)
        return np.flatnonzero(self.every_shingle[at] == shingles)

    def alike(self, shingles: np.ndarray, weights: np.ndarray, met: np.ndarray, inside: np.ndarray, size: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(window, passage) for all windows, by start in `inside`, that may be `least` alike: the letters of shared shingles are at least that part of the letters of
        all, so no such pair is left out."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if size not in self.shingles or not len(met) or least <= 0:
            return none
        known, starts, rows, letters = self.shingles[size]
        own = self.tables[size][0]
        at = np.minimum(np.searchsorted(known, shingles[met]), len(known) - 1)
        own_met = known[at] == shingles[met]
        shared, times, begins = np.zeros(len(shingles), bool), np.zeros(len(shingles), np.int64), np.zeros(len(shingles), np.int64)
        shared[met] = own_met
        times[met] = np.where(own_met, starts[at + 1] - starts[at], 0)
        begins[met] = starts[at]
        n = size - SHINGLE + 1
        every = run_sums(weights, n)[inside]
        most = run_sums(weights * shared, n)[inside]
        windows = np.flatnonzero((most > 0) & (most >= least * every - 1e-6))
        ends = np.cumsum(run_sums(times, n)[inside[windows]])
        found = [none]
        first = 0
        while first < len(windows):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + HITS, "right")))
            some = windows[first:last]
            place = (inside[some][:, None] + np.arange(n)).ravel()
            w = np.repeat(some, n)
            hit = shared[place]
            place, w = place[hit], w[hit]
            c = times[place]
            k = rows[np.repeat(begins[place], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)].astype(np.int64)
            pairs, which = np.unique(np.repeat(w, c) * len(own) + k, return_inverse=True)
            both = np.bincount(which, np.repeat(weights[place], c))
            w, k = pairs // len(own), pairs % len(own)
            near = both * (1 + least) >= least * (every[w] + letters[k]) - 1e-6
            found.append((w[near], own[k[near]]))
            first = last
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def similarity(a: tuple[str, ...] | list[str], b: tuple[str, ...] | list[str], shingle: int = SHINGLE) -> float:
    """Weighted Jaccard of word shingles, each weighing its letters; of single words where both are shorter than a shingle."""
    n = min(shingle, len(a), len(b)) or 1
    x, y = (Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1)) for s in (a, b))
    weight = lambda s: sum(map(len, s))
    both = sum(min(c, y[s]) * weight(s) for s, c in x.items() if s in y)
    every = sum(max(x[s], y[s]) * weight(s) for s in x.keys() | y.keys())
    return both / every if every else 0.0


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, radius: int = RADIUS, least: float = SIMILARITY) -> DataFrame:
    """Rows (doc_id, item_id, n_windows, similarity, exact): the documents with a window of an item's size (`window` words, or all words of a
    shorter item) whose weighted shingles are at least `least` alike to those of one of the item's; `exact` where a window has the very words. Equal windows and
    those whose fingerprints are within `radius` are found by SimHash, all others by the shingles they share, so that no near match is lost.

    Null texts and texts without words match nothing, on either side; texts are read whole at any length; items with the same words
    all come out; a repeated document gives its rows again; other columns are not read. An empty table on either side gives no rows.

    The documents are only scanned, never shuffled. The items are the stated query set: their passages are sent to the tasks, and no more than `ITEM_WORDS` words of
    them (counted first) at a time. Of more items each part scans the documents in turn and its rows are written, so driver and tasks never hold more than one part.
    """
    small = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).cast("string").alias("t")).filter(F.col("t").isNotNull())
    passes = small.agg(F.coalesce(F.sum(F.regexp_count("t", F.lit(WORD.pattern))), F.lit(0)).alias("n")).first()["n"] // ITEM_WORDS + 1
    if passes == 1:
        return scanned(docs, small, window, radius, doc_id, text, least)
    small = small.withColumn("part", F.pmod(F.xxhash64("i"), F.lit(passes)))
    return reduce(DataFrame.unionByName, [stage(scanned(docs, small.filter(F.col("part") == p), window, radius, doc_id, text, least), "leaks") for p in range(passes)])


def scanned(docs: DataFrame, items: DataFrame, window: int, radius: int, doc_id: str, text: str, least: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(Passages([(r["i"], r["t"]) for r in items.select("i", "t").collect()], window, radius))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = sent.value
        for batch in batches:
            rows: list[tuple] = []
            ids, texts, n = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words(t)
                if n + len(w) > CHUNK and ids:
                    rows += matches(passages, ids, texts, least)
                    ids, texts, n = [], [], 0
                if w:
                    ids.append(i)
                    texts.append(w)
                    n += len(w)
            rows += matches(passages, ids, texts, least)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.bool_()))],
                names=["doc_id", "item_id", "n_windows", "similarity", "exact"],
            )

    return docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string")).mapInArrow(run, "doc_id bigint, item_id bigint, n_windows int, similarity double, exact boolean")


def matches(passages: Passages, ids: list, texts: list[list[str]], least: float) -> list[tuple]:
    """(doc, item, windows, similarity, exact) of a chunk of documents."""
    if not ids or not passages.sizes:
        return []
    every = [w for t in texts for w in t]
    number: dict[str, int] = {}
    index = np.fromiter((number.setdefault(w, len(number)) for w in every), np.int64, len(every))
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(texts)), lengths)
    by_word = word_hashes(list(number))
    sign = signs(by_word)[index]
    totals, added = np.zeros(sign.shape, np.int8 if passages.sizes[-1] < 128 else np.int32), 0
    if len(every) >= SHINGLE:
        shingles, weights = shingle_hashes(by_word[index]), run_sums(np.array([len(w) for w in number])[index], SHINGLE)
        met = passages.met(shingles)
    best: dict[tuple[int, int], list] = {}
    for size in passages.sizes:
        if len(every) < size:
            continue
        n = len(every) - size + 1
        for k in range(added, size):
            totals[:n] += sign[k : k + n]
        added = size
        prints = fingerprints(totals[:n])
        inside = np.flatnonzero(np.arange(size, len(every) + 1) <= ends[doc[: len(prints)]])
        pairs = [passages.candidates(prints[inside], size)]
        if size > SHINGLE:
            pairs.append(passages.alike(shingles, weights, met, inside, size, least))
        w, k = np.divmod(np.unique(np.concatenate([a * len(passages.passages) + b for a, b in pairs])), len(passages.passages))
        for at, passage in zip(inside[w].tolist(), k.tolist()):
            own = tuple(every[at : at + size])
            same = own == passages.passages[passage]
            alike = 1.0 if same else similarity(own, passages.passages[passage])
            if alike >= least:
                for item in passages.owners[passage]:
                    b = best.setdefault((int(doc[at]), item), [0, 0.0, False])
                    b[0], b[1], b[2] = b[0] + 1, max(b[1], alike), b[2] or same
    return [(ids[d], item, *b) for (d, item), b in best.items()]
