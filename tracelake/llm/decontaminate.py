"""Benchmark decontamination: SimHash fingerprints of shingle-sized windows, multi-index Hamming search, exact check.

Words are runs of letters and digits, ASCII lower-cased. A text holds an item when, within some stretch of it half an
item longer than the item, the share of the item's five-word shingles, each weighted by one over the number of items
that hold it, reaches the threshold. Missing shingles then weigh at most one less the threshold, so any set of shingles
that weighs more has one in the text: an item gets a window on each of its heaviest shingles, until they weigh that
much. Whatever is changed, added or cut, at an end or inside, one of them stands in the text word for word.

Documents are cut into windows of five words at every word. A fingerprint is 64 bits, a majority vote over the hashes
of the window's words. Two fingerprints within ``RADIUS`` bits agree up to ``RADIUS // 4`` bits in one of four 16-bit
blocks; a block's near values point to the items' fingerprints, so none within the radius is missed. A candidate is
settled exactly, over every stretch of the text.

Holders of a shingle are counted over the whole benchmark. The benchmark is read in blocks of ``ITEM_BLOCK`` items; each block goes to the tasks and meets all documents in
one pass, without a shuffle. Every document is searched whole.

Defined cases: an item or text without words matches nothing; an item of fewer than five words is one shingle of
all its words; null ids are kept as they are; equal items are reported each; repeated rows are reported each; empty
tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.catalog import documents, query
from tracelake.llm.wordbytes import LOWER, NOT_ALNUM, Words, flat, mix, slices
from tracelake.session import stage

WIDTH = 5
THRESHOLD = 0.8
RADIUS = 7
ITEM_BLOCK = 5000
_BLOCKS = 4
#: Windows of a text that are looked up at once.
_WINDOWS = 1 << 16


def _runs(hashes: np.ndarray, width: int) -> np.ndarray:
    value = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
    for k in range(width):
        value = mix(value + hashes[k : k + len(value)])
    return value


def _fingerprints(hashes: np.ndarray, width: int) -> np.ndarray:
    """Majority of each bit over runs of ``width`` words (1 to 5); three planes count all 64 bits at once."""
    n = max(len(hashes) - width + 1, 0)
    one = two = four = np.zeros(n, np.uint64)
    for k in range(width):
        value = hashes[k : k + n]
        carry = one & value
        one, two, four = one ^ value, two ^ carry, four | (two & carry)
    return (one | two | four, two | four, four | (two & one))[width // 2]


class Index:
    """Fingerprints of a block of items by window size, and the items' weighted shingles.

    An item is item_id, text and (shingle, holders) of each shingle that other items hold, too.
    """

    def __init__(self, items: list[tuple[int | None, str | None, list[tuple[int, int]] | None]], threshold: float = THRESHOLD, radius: int = RADIUS):
        self.radius, self.threshold, self.items = radius, threshold, []
        data, offsets = flat(pa.array([t for _, t, _ in items], pa.large_string()))
        words = Words(LOWER[data], offsets, NOT_ALNUM)
        hashes = words.hashes()
        owns = []
        for k, (item_id, _, shared) in enumerate(items):
            own = hashes[words.row_start[k] : words.row_start[k + 1]]
            if len(own):
                owns.append(own)
                wanted, at = np.unique(_runs(own, min(WIDTH, len(own))), return_index=True)
                holders = dict(shared or [])
                weight = 1 / np.array([holders.get(x, 1) for x in wanted.view(np.int64).tolist()])
                self.items.append((item_id, len(own), wanted, at, weight))
        self.shingles = np.unique(np.concatenate([np.zeros(0, np.uint64), *(s for _, _, s, _, _ in self.items)]))
        windows = defaultdict(list)
        for slot, (own, (_, n, _, at, weight)) in enumerate(zip(owns, self.items, strict=True)):
            width = min(WIDTH, n)
            prints = _fingerprints(own, width)
            order = np.argsort(-weight, kind="stable")
            enough = np.cumsum(weight[order]) > (1 - threshold + 2e-9) * weight.sum()
            last = int(np.argmax(enough)) if enough.any() else len(order) - 1
            windows[width] += [(prints[k], slot) for k in at[order[: last + 1]].tolist()]
        self.classes = {width: self._tables(w, radius // _BLOCKS) for width, w in windows.items()}

    @staticmethod
    def _tables(windows: list[tuple], near: int) -> tuple:
        """Fingerprints, their items, and per block: which values are near one, and whose."""
        prints = np.array([w[0] for w in windows], np.uint64)
        flips = [0]
        for _ in range(near):
            flips = sorted({f ^ (1 << b) for f in flips for b in range(16)} | set(flips))
        blocks = []
        for part in prints.view(np.uint16).reshape(-1, _BLOCKS).T:
            value = (part[:, None] ^ np.array(flips, np.uint16)[None, :]).reshape(-1)
            order = np.argsort(value, kind="stable")
            bounds = np.searchsorted(value[order], np.arange(65537)).astype(np.int32)
            blocks.append((np.diff(bounds) > 0, bounds, (order // len(flips)).astype(np.int32)))
        return prints, np.array([w[1] for w in windows]), blocks

    def candidates(self, hashes: np.ndarray, row: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) of every window within the radius of an item's window."""
        out: set[tuple[int, int]] = set()
        for width, (prints, item, blocks) in self.classes.items():
            mine = _fingerprints(hashes, width)
            inside = row[: len(mine)] == row[width - 1 :][: len(mine)]
            for low in range(0, len(mine), _WINDOWS):
                part = mine[low : low + _WINDOWS]
                parts = part.view(np.uint16).reshape(-1, _BLOCKS)
                for b, (near, bounds, whose) in enumerate(blocks):
                    hit = np.flatnonzero(near[parts[:, b]] & inside[low : low + _WINDOWS])
                    value = parts[hit, b].astype(np.int64)
                    n = bounds[value + 1] - bounds[value]
                    window = np.repeat(hit, n)
                    other = whose[np.repeat(bounds[value] - np.cumsum(n) + n, n) + np.arange(len(window))]
                    close = np.bitwise_count(part[window] ^ prints[other]) <= self.radius
                    window, other = window[close], other[close]
                    out.update(zip(row[low + window].tolist(), item[other].tolist(), strict=True))
        return out

    def best(self, slot: int, at: np.ndarray, value: np.ndarray) -> tuple[float, int]:
        """Largest share of an item in a stretch, and the item's first word there; ``value`` = the row's shingles at ``at``."""
        _, n, wanted, offset, weight = self.items[slot]
        place = np.minimum(np.searchsorted(wanted, value), len(wanted) - 1)
        own = wanted[place] == value
        at, place = at[own], place[own]
        least = (self.threshold - 1e-9) * weight.sum()
        if weight[np.unique(place)].sum() < least:
            return 0.0, 0
        ends = np.searchsorted(at, at + (n + 2 * (n // 4) - min(WIDTH, n)), side="right").tolist()
        held, order, count = 0.0, place.tolist(), [0] * len(wanted)
        most, low, high, end = 0.0, 0, 0, 0
        for k, stop in enumerate(ends):
            if k:
                count[order[k - 1]] -= 1
                held -= 0.0 if count[order[k - 1]] else weight[order[k - 1]]
            for j in order[end:stop]:
                held += 0.0 if count[j] else weight[j]
                count[j] += 1
            end = stop
            if held > most + 1e-12:
                most, low, high = held, k, stop
        starts, n_same = np.unique(at[low:high] - offset[place[low:high]], return_counts=True)
        return float(weight[np.unique(place[low:high])].sum() / weight.sum()), max(int(starts[np.argmax(n_same)]), 0)

    def search(self, words: Words) -> list[tuple[int, int | None, float, int]]:
        """(row, item_id, similarity, first word in the row) of each item found in a row, at its best place."""
        hashes = words.hashes()
        out: list[tuple[int, int | None, float, int]] = []
        if not len(hashes) or not self.items:
            return out
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        last = -1
        for row, slot in sorted(self.candidates(hashes, words.row)):
            if row != last:
                known, last = {}, row
            width = min(WIDTH, self.items[slot][1])
            if width not in known:
                value = _runs(hashes[words.row_start[row] : words.row_start[row + 1]], width)
                place = np.minimum(np.searchsorted(self.shingles, value), len(self.shingles) - 1)
                at = np.flatnonzero(self.shingles[place] == value)
                known[width] = at, value[at]
            share, first = self.best(slot, *known[width])
            if share >= self.threshold - 1e-9:
                out.append((row, self.items[slot][0], share, first))
        return out


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct shingles of each item."""
    for batch in batches:
        for row, end, data, offsets in slices(batch.column("text")):
            words = Words(LOWER[data], offsets, NOT_ALNUM)
            hashes = words.hashes()
            sets = []
            for low, high in zip(words.row_start[:-1], words.row_start[1:], strict=True):
                sets.append(np.unique(_runs(hashes[low:high], min(WIDTH, high - low))) if high > low else np.zeros(0, np.uint64))
            key = batch.column("key").slice(row, end - row).take(pa.array(np.repeat(np.arange(end - row), [len(x) for x in sets])))
            yield pa.record_batch([key, pa.array(np.concatenate(sets).view(np.int64))], ["key", "shingle"])


def _weighed(benchmark: DataFrame) -> DataFrame:
    """item_id, text and the holders, over the whole benchmark, of each shingle that several items hold."""
    items = stage(benchmark.select(F.monotonically_increasing_id().alias("key"), F.col("item_id").cast("long"), "text"), "items")
    shingles = items.select("key", "text").mapInArrow(_item_shingles, "key long, shingle long")
    shared = shingles.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    holders = shingles.join(shared, "shingle").groupBy("key").agg(F.collect_list(F.struct("shingle", "n")).alias("shared"))
    return stage(items.join(holders, "key", "left").select("item_id", "text", "shared"), "weighed")


def _blocks(benchmark: DataFrame, size: int) -> Iterator[list[Row]]:
    rows = _weighed(benchmark).toLocalIterator()
    while block := list(islice(rows, size)):
        yield block


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, item_block: int = ITEM_BLOCK) -> DataFrame:
    """(doc_id, item_id, similarity, first_word) of every benchmark item found in a document."""

    def search(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, end, data, offsets in slices(batch.column("text")):
                    hits = index.search(Words(LOWER[data], offsets, NOT_ALNUM))
                    ids = batch.column("doc_id").slice(row, end - row).take(pa.array([h[0] for h in hits], pa.int64()))
                    yield pa.record_batch(
                        [
                            ids, pa.array([h[1] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.float64()),
                            pa.array([h[3] for h in hits], pa.int64()),
                        ],
                        ["doc_id", "item_id", "similarity", "first_word"],
                    )

        return run

    schema = "doc_id long, item_id long, similarity double, first_word long"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = [texts.mapInArrow(search(Index([tuple(r) for r in block], threshold)), schema) for block in _blocks(benchmark, item_block)]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, item_block: int = ITEM_BLOCK) -> DataFrame:
    """``docs`` without the rows in which a benchmark item is found; every column is kept."""

    def clean(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, end, data, offsets in slices(batch.column("text")):
                    keep = np.ones(end - row, bool)
                    keep[[h[0] for h in index.search(Words(LOWER[data], offsets, NOT_ALNUM))]] = False
                    yield batch.slice(row, end - row).filter(pa.array(keep))

        return run

    for block in _blocks(benchmark, item_block):
        docs = docs.mapInArrow(clean(Index([tuple(r) for r in block], threshold)), docs.schema)
    return docs


@query("op8_decontaminate")
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
