"""Removal of repeated byte strings by a sparse suffix array over all texts.

A byte goes if a string of ``length`` bytes over it also starts anywhere else. Two equal strings hold the same bytes, so they agree in
their anchor, the leftmost place of the least hash among their short runs of bytes (``length // 4`` each); a string can therefore only repeat
if its anchor's run does. Suffixes that start at anchors whose run occurs once are left out. Of each other anchor the stretch is
kept that covers all strings it is the anchor of (``length`` and about half as many bytes); equal stretches of a slice are one entry
with a count.

Entries are range-partitioned by their suffixes, with splitters that Spark samples. A bucket folds equal entries, sorts the strings of
the others by multikey quicksort (eight bytes at a time, all parts of a depth at once), and compares neighbours: strings that
agree in all words are repeated. The run at an end of a bucket may go on in the next. What an entry there shares with its bucket's
last suffix bounds what it shares with any other bucket; where that leaves strings to compare, the entry goes on to a second order,
by the bytes before the anchors, with the same work and the same bound at its ends, and only strings that pass both bounds are
compared by hash. So a hot run is cut over many buckets like any other. All strings of an anchor hold it, so what an entry
removes is one interval.

Distinct texts are shuffled once, by digest, to meet their repeated runs, and stay bucketed by it for the cut. Hashes choose candidates;
runs and strings within a bucket are compared by their bytes, equal stretches by 128-bit digests.

Defined cases: a null or empty text has no bytes, and no bytes are kept of it; texts shorter than ``length`` lose nothing; a text longer
than ``PIECE_BYTES`` is searched in pieces that overlap so that no string is cut; repeated rows repeat each other's strings; rows that
share a doc_id or have none are separate; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.catalog import documents, query
from tracelake.llm.wordbytes import flat, mix, slices
from tracelake.session import scratch_dir, stage

LENGTH = 200
PIECE_BYTES = 1 << 21
BUCKET_BYTES = 16 << 20
EDGE_ENTRIES = 4000
_KEY_BYTES = 16
_PLACE = np.uint64(24)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _hashes(data: np.ndarray, width: int, base: int = _BASES[0]) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` bytes, by differences of one running polynomial."""
    powers = []
    for factor in (base, pow(base, -1, 1 << 64)):
        steps = np.full(len(data), factor, np.uint64)
        steps[:1] = 1
        powers.append(np.cumprod(steps))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[0], out=total[1:])
    return mix((total[width:] - total[:-width]) * powers[1][: len(data) - width + 1])


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


class Anchors:
    """Anchors of the strings of a slice of texts: hash of the run, place, and first and last string start of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        self.run = max(1, length // 4)
        found = []
        sizes = np.diff(offsets)
        for lo, hi in self._pieces(offsets, length) if (sizes >= length).any() else []:
            if hi - lo < length:
                continue
            hashes = _hashes(data[lo:hi], self.run)
            packed = (hashes >> _PLACE << _PLACE) | np.arange(len(hashes), dtype=np.uint64)
            place = (_sliding_least(packed, length - self.run + 1) & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
            whole = np.zeros(len(place) + 1, np.int64)  # +1 where starts of a text begin, -1 where they end
            inside = np.clip(np.stack([offsets[:-1], offsets[1:] - length + 1]) - lo, 0, len(place))
            inside = inside[:, inside[0] < inside[1]]
            np.add.at(whole, inside[0], 1)
            np.add.at(whole, inside[1], -1)
            start = np.flatnonzero(np.cumsum(whole[:-1]))
            if not len(start):
                continue
            at = place[start]
            change = np.flatnonzero(np.diff(at, prepend=-1))
            found.append((hashes[at[change]], at[change] + lo, start[change] + lo, start[np.append(change[1:], len(start)) - 1] + lo))
        empty = np.zeros(0, np.int64)
        self.hash, self.at, self.first, self.last = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (empty.astype(np.uint64), empty, empty, empty)
        self.row = np.searchsorted(offsets, self.first, side="right") - 1

    @staticmethod
    def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
        for lo in range(0, int(offsets[-1]), PIECE_BYTES):
            yield lo, min(lo + PIECE_BYTES + length - 1, int(offsets[-1]))


def _profile(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, key, n_bytes and digest of every row, and the hashes of its anchors' runs, each at most twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in slices(batch.column("text")):
                anchors = Anchors(data, offsets, length)
                order = np.lexsort((anchors.hash, anchors.row))
                h, r = anchors.hash[order], anchors.row[order]
                keep = np.ones(len(h), bool)
                keep[2:] = (h[2:] != h[:-2]) | (r[2:] != r[:-2])
                runs = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(r[keep], np.arange(end - row + 1)), pa.int32()), pa.array(h[keep].view(np.int64))
                )
                raw, at = data.tobytes(), offsets.tolist()
                digests = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.record_batch(
                    [batch.column("doc_id").slice(row, end - row), pa.array([d[:_KEY_BYTES] for d in digests], pa.binary()), pa.array(np.diff(offsets)),
                     pa.array(digests, pa.binary()), runs],
                    ["doc_id", "key", "n_bytes", "digest", "runs"],
                )

    return docs.mapInArrow(run, "doc_id long, key binary, n_bytes long, digest binary, runs array<long>")


def _entries(flagged: DataFrame, length: int) -> DataFrame:
    """Of distinct texts with their repeated runs: ``block`` rows (one per distinct stretch of a slice, with its count), rows with ``key``, ``c1``
    and ``low`` (one per stretch that a slice holds once) and rows with ``key`` and ``high`` (what is repeated inside the slice)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in slices(batch.column("text")):
                anchors = Anchors(data, offsets, length)
                key, repeated, copies = (batch.column(c).slice(row, end - row) for c in ("key", "repeated", "copies"))
                bounds, values = repeated.offsets.to_numpy(), repeated.values.to_numpy().view(np.uint64)
                own = np.searchsorted(anchors.row, np.arange(end - row + 1))
                mask = np.zeros(len(anchors.row), bool)
                for k in range(end - row):
                    mask[own[k] : own[k + 1]] = np.isin(anchors.hash[own[k] : own[k + 1]], values[bounds[k] : bounds[k + 1]])
                chosen = np.flatnonzero(mask)
                first, stop, before = anchors.first[chosen], anchors.last[chosen] + length, anchors.at[chosen] - anchors.first[chosen]
                raw = data.tobytes()
                cuts = zip(first.tolist(), stop.tolist(), before.tolist(), strict=True)
                ids = b"".join(hashlib.blake2b(raw[a:b], digest_size=16, salt=n.to_bytes(8, "little")).digest() for a, b, n in cuts)
                _, sample, kind = np.unique(np.frombuffer(ids, "V16"), return_index=True, return_inverse=True)
                n = np.bincount(kind, copies.to_numpy()[anchors.row[chosen]], len(sample)).astype(np.int64)
                halves = np.frombuffer(ids, np.int64).reshape(-1, 2)
                blocks = [raw[a:b] for a, b in zip(first[sample].tolist(), stop[sample].tolist(), strict=True)]
                yield _entry(c1=halves[sample, 0], c2=halves[sample, 1], before=before[sample], block=pa.array(blocks, pa.binary()), n=np.minimum(n, 2))
                text, base = anchors.row[chosen], offsets[anchors.row[chosen]]
                once = n[kind] == 1
                yield _entry(c1=halves[once, 0], c2=halves[once, 1], key=key.take(pa.array(text[once])), low=(first - base)[once])
                text, low, high = merged(text[~once], (first - base)[~once], (stop - base)[~once])
                yield _entry(key=key.take(pa.array(text)), low=low, high=high)

    return stage(flagged.mapInArrow(run, _ENTRY), "suffix-entries")


_ENTRY = "c1 long, c2 long, before int, block binary, n int, key binary, low long, high long"
_FOUND = "c1 long, c2 long, low long, high long, before int, least int, block binary, lead binary, h1 long, h2 long, bucket int"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _record(schema: str, columns: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    """A batch of the schema; columns that are not given are null."""
    n = len(next(iter(columns.values())))
    fields = {name: _KINDS[kind] for name, kind in (c.split() for c in schema.split(", "))}
    arrays = [pa.nulls(n, t) if name not in columns else pa.array(columns[name]).cast(t) for name, t in fields.items()]
    return pa.record_batch(arrays, list(fields))


def _entry(**columns) -> pa.RecordBatch:
    return _record(_ENTRY, columns)


def _found(**columns) -> pa.RecordBatch:
    return _record(_FOUND, columns)


def merged(group: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of intervals within each group, in order; touching ones become one."""
    if not len(group):
        return group, low, high
    order = np.lexsort((low, group))
    group, low, high = group[order], low[order], high[order]
    shift = (group - group.min()) * (int(high.max()) + 2)  # groups do not touch
    reach = np.maximum.accumulate(high + shift)
    begin = np.ones(len(group), bool)
    begin[1:] = (low + shift)[1:] > reach[:-1]
    at = np.flatnonzero(begin)
    last = np.append(at[1:], len(group)) - 1
    return group[at], low[at], (reach - shift)[last]


def repeated_strings(data: np.ndarray, start: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which strings of ``length`` bytes equal another of their group, by multikey quicksort: sorted and parted word by word, lone ones drop out."""
    out = np.zeros(len(start), bool)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), ">u8", buffer=padded, strides=(1,))
    width = min(8, length)
    index = np.arange(len(start))
    for depth in [*range(0, length - width, width), length - width]:
        word = words[start[index] + depth].astype(np.uint64)
        if width < 8:
            word >>= np.uint64(8 * (8 - width))
        order = np.lexsort((word, group))
        index, word, group = index[order], word[order], group[order]
        begin = np.ones(len(index), bool)
        begin[1:] = (group[1:] != group[:-1]) | (word[1:] != word[:-1])
        lone = begin & np.append(begin[1:], True)
        group = np.cumsum(begin)[~lone]
        index = index[~lone]
    out[index] = True
    return out


def _strings(owners: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and place of the strings that start at [first, stop) of each owner's stretch."""
    counts = np.maximum(stop - first, 0)
    return np.repeat(owners, counts), np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts - first, counts)


class Bucket:
    """Entries of a bucket: their stretches, where the anchors stand in them, and which share their anchor's run."""

    def __init__(self, c1: np.ndarray, c2: np.ndarray, before: np.ndarray, blocks: pa.Array, length: int):
        self.c1, self.c2, self.before, self.blocks, self.length = c1, c2, before.astype(np.int64), blocks, length
        self.data, self.offsets = flat(blocks)
        self.size, self.run = np.diff(self.offsets), max(1, length // 4)
        windows = np.lib.stride_tricks.sliding_window_view(self.data, self.run)
        leading = np.ascontiguousarray(windows[self.offsets[:-1] + self.before]).view(f"V{self.run}").ravel()
        self.kinds, self.kind, self.members = np.unique(leading, return_inverse=True, return_counts=True)

    def repeated(self, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries with strings that repeat here, of those with at least so many bytes before the anchor, and the interval over them (all
        hold the anchor)."""
        shared = np.flatnonzero(self.members[self.kind] >= 2)
        stop = np.minimum(self.size - self.length, self.before - least) + 1
        owner, inner = _strings(shared, np.zeros(len(shared), np.int64), stop[shared])
        group = self.kind[owner] * self.length + self.before[owner] - inner
        hit = repeated_strings(self.data, self.offsets[owner] + inner, group, self.length)
        owner, inner = owner[hit], inner[hit]
        entry, at = np.unique(owner, return_index=True)
        last = np.append(at[1:], len(owner))[: len(at)] - 1
        return entry, inner[at], inner[last] + self.length

    def edges(self, backward: bool) -> tuple[np.ndarray, np.ndarray]:
        """Entries of the first and the last run of the bucket, and how many bytes each shares, from its anchor on or back, with the
        bucket's end: no entry of another bucket shares more."""
        share = np.full(len(self.c1), -1)
        for kind in {0, len(self.kinds) - 1}:
            some = np.flatnonzero(self.kind == kind)
            if backward:
                bytes_of = [self.data[self.offsets[k] : self.offsets[k] + self.before[k]][::-1].tobytes() for k in some.tolist()]
            else:
                bytes_of = [self.data[self.offsets[k] + self.before[k] : self.offsets[k + 1]].tobytes() for k in some.tolist()]
            ends = [pick(bytes_of) for pick, at in ((min, 0), (max, len(self.kinds) - 1)) if kind == at]
            share[some] = [max(len(commonprefix((x, e))) for e in ends) for x in bytes_of]
        edge = np.flatnonzero(share >= 0)
        return edge, share[edge]


def _fold(table: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """What each entry of a bucket of suffixes removes, and the entries that may share strings with another bucket."""
    entries = table.group_by(["c1", "c2"], use_threads=False).aggregate([("before", "min"), ("block", "first"), ("n", "sum")]).combine_chunks()
    c1, c2, n, before = (entries.column(c).to_numpy() for c in ("c1", "c2", "n_sum", "before_min"))
    bucket = Bucket(c1, c2, before, entries.column("block_first").combine_chunks(), length)
    low, high = np.zeros(len(c1), np.int64), np.zeros(len(c1), np.int64)
    entry, first, stop = bucket.repeated(low)
    low[entry], high[entry] = first, stop
    low[n >= 2], high[n >= 2] = 0, bucket.size[n >= 2]
    hit = np.flatnonzero(high)
    yield _found(c1=c1[hit], c2=c2[hit], low=low[hit], high=high[hit])
    edge, share = bucket.edges(backward=False)
    least = np.maximum(length - share, 0)  # a string with fewer bytes before the anchor has more behind it than any other bucket shares
    edge, least = edge[least <= bucket.before[edge]], least[least <= bucket.before[edge]]
    ends = [bucket.kinds[k].tobytes() + bucket.blocks[e].as_py()[: bucket.before[e]][::-1] for k, e in zip(bucket.kind[edge].tolist(), edge.tolist(), strict=True)]
    yield _found(
        c1=c1[edge], c2=c2[edge], low=low[edge], high=high[edge], before=bucket.before[edge], least=least, block=bucket.blocks.take(pa.array(edge)),
        lead=pa.array(ends, pa.binary()),
    )


def _across(number: int, table: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """The same for entries from the ends of buckets, now in order of the bytes before their anchors; what may go on in another bucket
    of this order too is left as hashes of strings: with their entry where they would add to what it removes, else once each."""
    c1, c2, before, least, low, high = (table.column(c).to_numpy() for c in ("c1", "c2", "before", "least", "low", "high"))
    bucket = Bucket(c1, c2, before, table.column("block").combine_chunks(), length)
    entry, first, stop = bucket.repeated(least)
    yield _found(c1=c1[entry], c2=c2[entry], low=first, high=stop)
    low, high = low.copy(), high.copy()
    low[entry], high[entry] = np.where(high[entry] > 0, np.minimum(low[entry], first), first), np.maximum(high[entry], stop)
    edge, share = bucket.edges(backward=True)
    for at in range(0, len(edge), EDGE_ENTRIES):
        some = edge[at : at + EDGE_ENTRIES]
        part, starts = flat(bucket.blocks.take(pa.array(some)))
        first = bucket.before[some] - np.minimum(share[at : at + EDGE_ENTRIES], bucket.before[some])
        owner, inner = _strings(np.arange(len(some)), first, np.minimum(bucket.size[some] - length, bucket.before[some] - least[some]) + 1)
        h1, h2 = (_hashes(part, length, b)[starts[owner] + inner].view(np.int64) for b in _BASES)
        entry = some[owner]
        asks = (inner < low[entry]) | (inner + length > high[entry])
        yield _found(c1=c1[entry[asks]], c2=c2[entry[asks]], low=inner[asks], high=inner[asks] + length, h1=h1[asks], h2=h2[asks], bucket=np.full(int(asks.sum()), number))
        told = np.flatnonzero(~asks)
        told = told[np.unique(h1[told], return_index=True)[1]]
        yield _found(h1=h1[told], h2=h2[told], bucket=np.full(len(told), number))


def _per_bucket(work: Callable[[int, pa.Table], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if sum(map(len, got)):
            yield from work(TaskContext.get().partitionId(), pa.Table.from_batches(got))

    return run


def _removed(entries: DataFrame, length: int, bucket_bytes: int) -> DataFrame:
    """c1, c2, from, to: the interval that goes from each distinct stretch."""
    spark = entries.sparkSession
    blocks = entries.where(F.col("block").isNotNull()).select("c1", "c2", "before", "block", "n")
    n_bytes = blocks.agg(F.sum(F.length("block"))).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    suffix = F.expr("substring(block, before + 1, length(block))")
    in_order = blocks.repartitionByRange(max(tasks, -(-n_bytes // bucket_bytes)), suffix, "c1", "c2")
    found = stage(in_order.mapInArrow(_per_bucket(lambda _, table: _fold(table, length)), _FOUND), "suffix-buckets")
    ends = found.where(F.col("block").isNotNull()).select("c1", "c2", "low", "high", "before", "least", "block", "lead")
    ends = ends.repartitionByRange(max(tasks, -(-n_bytes // bucket_bytes)), "lead", "c1", "c2")
    across = stage(ends.mapInArrow(_per_bucket(lambda number, table: _across(number, table, length)), _FOUND), "suffix-ends")
    strings = across.where(F.col("bucket").isNotNull())
    shared = strings.groupBy("h1", "h2").agg(F.min("bucket").alias("first"), F.max("bucket").alias("last")).where("first < last").select("h1", "h2")
    parts = [
        found.where(F.col("block").isNull()), across.where(F.col("bucket").isNull()), strings.where(F.col("c1").isNotNull()).join(shared, ["h1", "h2"], "left_semi"),
    ]
    intervals = [x.select("c1", "c2", "low", "high") for x in parts]
    return intervals[0].unionByName(intervals[1]).unionByName(intervals[2]).groupBy("c1", "c2").agg(F.min("low").alias("from"), F.max("high").alias("to"))


def _cut(texts: DataFrame) -> DataFrame:
    """key, n_removed, n_spans and the digest of what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans"), strict=True):
                raw = text.encode()
                low, high = (spans.values.field(k).to_numpy() for k in (0, 1))
                _, low, high = merged(np.zeros(len(low), np.int64), low, high)
                left, at = hashlib.sha256(), 0
                for a, b in zip(low.tolist(), high.tolist(), strict=True):
                    left.update(raw[at:a])
                    at = b
                left.update(raw[at:])
                out.append((int((high - low).sum()), len(low), left.digest()))
            removed, n, digest = zip(*out, strict=True) if out else ((), (), ())
            yield pa.record_batch(
                [batch.column("key"), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary())],
                ["key", "n_removed", "n_spans", "kept"],
            )

    return texts.mapInArrow(run, "key binary, n_removed long, n_spans long, kept binary")


def _bucketed(texts: DataFrame) -> DataFrame:
    """The table written in buckets of its key, so that a join by key reads it in place."""
    spark, name = texts.sparkSession, f"suffix_texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts.write.bucketBy(buckets, "key").option("path", scratch_dir(spark, "suffix-texts")).saveAsTable(name)
    return spark.table(name)


def dedup(docs: DataFrame, length: int = LENGTH, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    profile = stage(_profile(rows, length).withColumn("id", F.monotonically_increasing_id()), "suffix-profile")
    # of equal texts one is searched, and counts as two
    distinct = profile.groupBy("key").agg(F.min("id").alias("id"), F.least(F.count("*"), F.lit(2)).alias("copies"))
    runs = profile.select("id", F.explode("runs").alias("run"))
    repeated = runs.groupBy("run").agg(F.count("*").alias("n")).where("n >= 2").select("run")
    flagged = runs.join(repeated, "run").groupBy("id").agg(F.collect_set("run").alias("repeated")).join(distinct, "id").drop("id")
    key = F.substring(F.unhex(F.sha2("text", 256)), 1, _KEY_BYTES)
    texts = rows.where(F.octet_length("text") >= length).select(key.alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    texts = _bucketed(texts.join(flagged, "key"))
    entries = _entries(texts, length)
    uses = entries.where("key IS NOT NULL AND c1 IS NOT NULL").select("c1", "c2", "key", F.col("low").alias("at"))
    spans = uses.join(_removed(entries, length, bucket_bytes), ["c1", "c2"]).select("key", (F.col("at") + F.col("from")).alias("low"), (F.col("at") + F.col("to")).alias("high"))
    spans = spans.unionByName(entries.where("key IS NOT NULL AND c1 IS NULL").select("key", "low", "high"))
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    cut = _cut(texts.select("key", "text").join(spans, "key"))
    left = profile.select("doc_id", "key", "n_bytes", "digest").join(cut, "key", "left")
    return left.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.lower(F.hex(F.coalesce("kept", "digest"))).alias("kept_sha256"),
    )


@query("op13_suffix_dedup")
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))
