"""Toxicity by subword bags: n-gram vectors averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its byte n-grams (3 to 6, with marks at both ends) and of itself, so unseen
misspellings share most of their vectors with the word they twist. A window is the mean of its words, and a
linear softmax turns it into a probability. Insults are a few words in a long text, so a text is cut into
overlapping windows of ``WINDOW`` words and scores as its worst window (a word that recurs in a window counts
once, and places left over count as neutral). Training sees labels of whole texts
only: a toxic text teaches by its worst window, a clean one by its worst and by random windows.

At most ``MAX_PER_CLASS`` labelled rows of each class and ``MAX_BYTES`` of their text are learned from (those with the smallest
hash, whole texts only), in one task, so training costs the same at any size. The model that goes to the tasks is one number per
bucket, 2 ** ``BUCKET_BITS`` of them.

Defined cases: a null or empty text scores as a window without words; without labels of both classes every
score is 0; null labels and null ids are not learned from; a doc_id labelled twice is toxic if any label says so;
repeated rows are scored each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import wordbytes
from tracelake.llm.catalog import documents, query
from tracelake.llm.wordbytes import LOWER, NOT_ALNUM, Words, mix, slices

GRAMS = (3, 4, 5, 6)
BUCKET_BITS = 17
DIMENSIONS = 8
WINDOW = 16
STRIDE = 8
MAX_PER_CLASS = 2000
MAX_BYTES = 16 << 20
EPOCHS = 24
WARM_EPOCHS = 12
BATCH = 64
CUT = 0.3


def _spelled(words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the chosen words, each between two marks, and the offset of each."""
    start, size = words.start[chosen], words.end[chosen] - words.start[chosen]
    offsets = np.concatenate([[0], np.cumsum(size + 2)])
    owner = np.repeat(np.arange(len(chosen)), size)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    out = np.zeros(offsets[-1], np.uint8)
    out[offsets[:-1]], out[offsets[1:] - 1] = 2, 3
    out[offsets[owner] + 1 + within] = words.data[start[owner] + within]
    return out, offsets


def _grams(words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the chosen words' n-grams and of the words themselves, and the offset of each word's."""
    spelled, offsets = _spelled(words, chosen)
    powers, inverse = wordbytes._powers(len(spelled))
    total = np.zeros(len(spelled) + 1, np.uint64)
    np.cumsum((spelled.astype(np.uint64) + np.uint64(1)) * powers[: len(spelled)], out=total[1:])
    size = np.diff(offsets)
    at, upto, owner = [offsets[:-1]], [offsets[1:]], [np.arange(len(chosen))]
    for n in GRAMS:
        number = np.maximum(size - n + 1, 0)
        own = np.repeat(np.arange(len(chosen)), number)
        first = offsets[own] + np.arange(len(own)) - np.repeat(np.cumsum(number) - number, number)
        at.append(first)
        upto.append(first + n)
        owner.append(own)
    at, upto, owner = np.concatenate(at), np.concatenate(upto), np.concatenate(owner)
    bucket = (mix((total[upto] - total[at]) * inverse[at]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.searchsorted(owner[order], np.arange(len(chosen) + 1))


def _vocabulary(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word number of each word of the texts, words per text, and the buckets of each distinct word with their offsets.

    Built slice by slice, so that the arrays held at once do not grow with the texts.
    """
    known, every, counts, buckets, sizes = [np.zeros(0, np.uint64)], [], [], [], []
    seen = np.zeros(0, np.uint64)
    for _, _, data, offsets in slices(pa.array(texts, pa.large_string())):
        words = Words(LOWER[data], offsets, NOT_ALNUM)
        hashes = words.hashes()
        every.append(hashes)
        counts.append(np.diff(words.row_start))
        value, chosen = np.unique(hashes, return_index=True)
        new = ~np.isin(value, seen, assume_unique=True)
        known.append(value[new])
        seen = np.union1d(seen, value[new])
        for lo in range(0, int(new.sum()), 10_000):
            bucket, bounds = _grams(words, chosen[new][lo : lo + 10_000])
            buckets.append(bucket)
            sizes.append(np.diff(bounds))
    vocabulary = np.concatenate(known)
    order = np.argsort(vocabulary)
    word = [order[np.searchsorted(vocabulary, h, sorter=order)].astype(np.int32) for h in every]
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([[0][:0], *sizes]))]).astype(np.int64)
    return (
        np.concatenate([np.zeros(0, np.int32), *word]), np.concatenate([np.zeros(0, np.int64), *counts]),
        np.concatenate([np.zeros(0, np.int32), *buckets]), bounds,
    )


def _windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end word and row of every window of rows with ``counts`` words; a row without words has none."""
    number = np.where(counts == 0, 0, np.maximum(-(-(counts - WINDOW) // STRIDE), 0) + 1)
    row = np.repeat(np.arange(len(counts)), number)
    start = np.cumsum(counts) - counts
    first = start[row] + STRIDE * (np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number))
    return first, np.minimum(first + WINDOW, (start + counts)[row]), row


def _members(word: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window and word of each distinct word of each window: a word that recurs in a window counts once there."""
    before = np.full(len(word), -1)
    order = np.argsort(word, kind="stable")
    same = word[order[1:]] == word[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    size = end - first
    window = np.repeat(np.arange(len(first)), size)
    at = first[window] + np.arange(len(window)) - np.repeat(np.cumsum(size) - size, size)
    fresh = before[at] < first[window]
    return window[fresh].astype(np.int32), word[at[fresh]].astype(np.int32)


class Model:
    """``table``: score of each bucket (its vector times the difference of the class weights); ``bias``: of a window without words."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability per row of its worst window."""
        words = Words(LOWER[data], offsets, NOT_ALNUM)
        logit = np.full(len(offsets) - 1, self.bias)
        if len(words):
            _, chosen, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
            bucket, bounds = _grams(words, chosen)
            mean = np.add.reduceat(self.table[bucket], bounds[:-1]) / np.diff(bounds)
            first, end, row = _windows(np.diff(words.row_start))
            window, word = _members(inverse, first, end)
            each = np.bincount(window, mean[word], len(first)) / WINDOW + self.bias
            logit[np.unique(row)] = np.maximum.reduceat(each, np.flatnonzero(np.diff(row, prepend=-1)))
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def fit(texts: list[str | None], labels: np.ndarray, seed: int = 1) -> Model:
    """Train vectors and softmax together (Adagrad) on whole labelled texts."""
    labels = np.asarray(labels)
    if not (labels == 1).any() or not (labels == 0).any():
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), -60.0)
    rng = np.random.default_rng(seed)
    word, counts, bucket, bounds = _vocabulary(texts)
    first, end, row = _windows(counts)
    per_row = np.bincount(row, minlength=len(texts))
    start = np.cumsum(per_row) - per_row
    full = np.flatnonzero(per_row)
    window, member = _members(word, first, end)
    held = np.searchsorted(window, np.arange(len(first) + 1))
    vectors = rng.normal(0, 0.02, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    weights = rng.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen = [np.full(len(vectors), 1e-6, np.float32), np.full(weights.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)]
    # both classes weigh the same in all, however many rows they have
    per_class = len(full) / (2 * np.maximum(np.bincount(labels[full], minlength=2), 1))
    for epoch in range(EPOCHS):
        scores = vectors @ (weights[:, 1] - weights[:, 0])
        mean = np.add.reduceat(scores[bucket], bounds[:-1]) / np.diff(bounds) if len(bucket) else np.zeros(0)
        logit = np.bincount(window, mean[member], len(first))
        order = np.lexsort((-logit, row))
        worst = order[start[full]]
        guess = start[full] + (rng.random(len(full)) * per_row[full]).astype(np.int64)
        if epoch < WARM_EPOCHS:
            again = [start[full] + (rng.random(len(full)) * per_row[full]).astype(np.int64) for _ in range(3)]
            picked = np.concatenate([guess, *again])
        else:
            picked = np.concatenate([worst, guess[labels[row[guess]] == 0]])
        rng.shuffle(picked)
        for lo in range(0, len(picked), BATCH):
            batch = picked[lo : lo + BATCH]
            y = labels[row[batch]]
            length = held[batch + 1] - held[batch]
            owner = np.repeat(np.arange(len(batch)), length)
            ids = member[held[batch][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)]
            n = bounds[ids + 1] - bounds[ids]
            gram_word = np.repeat(np.arange(len(ids)), n)
            gram = bucket[bounds[ids][gram_word] + np.arange(len(gram_word)) - np.repeat(np.cumsum(n) - n, n)]
            share = (1 / (n * WINDOW)).astype(np.float32)[gram_word]
            gram_window = owner[gram_word]
            hidden = np.zeros((len(batch), DIMENSIONS), np.float32)
            for d in range(DIMENSIONS):
                hidden[:, d] = np.bincount(gram_window, vectors[gram, d] * share, len(batch))
            z = hidden @ weights + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), y] -= 1
            p *= (per_class[y] / len(batch)).astype(np.float32)[:, None]
            back = p @ weights.T
            used, at = np.unique(gram, return_inverse=True)
            step = np.zeros((len(used), DIMENSIONS), np.float32)
            for d in range(DIMENSIONS):
                step[:, d] = np.bincount(at, back[gram_window, d] * share, len(used))
            for k, (value, index, slope) in enumerate(((vectors, used, step), (weights, slice(None), hidden.T @ p), (bias, slice(None), p.sum(axis=0)))):
                seen[k][index] += (slope**2).mean(axis=1) if k == 0 else slope**2
                scale = np.sqrt(seen[k][index])
                value[index] -= 0.3 * slope / (scale[:, None] if k == 0 else scale)
    return Model((vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def _held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, max_bytes: int = MAX_BYTES) -> Model:
    """A model of the labelled rows that are not held out; at most ``max_per_class`` of each class, and whole texts of at most ``max_bytes``
    in all (a text that goes beyond is left out). It is learned in one task; the driver gets its table of bucket scores."""
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~_held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    ranked = [ids.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class) for k in (0, 1)]
    # at most 2 * max_per_class ids: a bounded side to broadcast, and a bounded number of rows to learn from, in one task
    rows = texts.join(F.broadcast(ranked[0].unionByName(ranked[1])), "doc_id").repartition(1)
    rows = rows.sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", F.desc("text"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[str | None, int]] = {}
        left = [max_bytes, max_bytes]
        for batch in batches:
            for doc_id, text, toxic in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True):
                size = len((text or "").encode())
                if doc_id not in kept and size <= left[toxic]:
                    kept[doc_id] = text, toxic
                    left[toxic] -= size
        some = [kept[k] for k in sorted(kept)]
        model = fit([t for t, _ in some], np.array([y for _, y in some], np.int64))
        yield pa.record_batch([pa.array([model.table.tobytes()], pa.binary()), pa.array([float(model.bias)])], ["table", "bias"])

    found = rows.mapInArrow(learn, "table binary, bias double").first()
    return Model(np.frombuffer(found["table"], np.float32), found["bias"]) if found else fit([], np.zeros(0, np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in slices(batch.column("text")):
                part = batch.slice(row, end - row)
                p = model.score(data, offsets)
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= CUT).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out().alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int"
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the model calls toxic; every column is kept."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in slices(batch.column("text")):
                yield batch.slice(row, end - row).filter(pa.array(model.score(data, offsets) < CUT))

    return docs.mapInArrow(run, docs.schema)


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
