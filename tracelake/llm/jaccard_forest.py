"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Texts are sets of five-word shingles (words between ASCII white space, as written). Equal sets form a *class*.
One pass over the texts makes, per document, a digest of its set and ``TREES`` labels of minhash values. A
label is a path in a prefix trie; two texts meet where their paths share a prefix. The prefix starts at ``DEPTH``
values and is shortened until texts at the threshold meet in some tree with probability ``RECALL``
(``prefix_length``). Texts that meet, directly or through others, form a cell; inside a cell every pair is
compared exactly, in blocks of about ``BLOCK`` classes, so a cell of thousands of near copies is spread over
many tasks, no pair is written, and a task returns only sums per class and the groups it found.

Defined cases: a null or empty text has no shingle, so it links to nothing; a text of one to four words is one
shingle of all its words; copies (also repeated rows of one ``doc_id``) share a class and link to each other;
rows with a null doc_id take part like others: a group's class_id is its smallest doc_id that is not null, or null if
all are; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tracelake.llm.catalog import documents, query
from tracelake.llm.components import connected
from tracelake.llm.wordbytes import Words, mix, shingles, slices
from tracelake.session import stage

WIDTH = 5
THRESHOLD = 0.8
TREES = 24
DEPTH = 8
RECALL = 0.9999
BLOCK = 128
#: Columns of the one-hot matrix that a comparison holds at once.
_COLUMNS = 4096


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Longest prefix at which a pair at the threshold shares some tree's prefix with probability ``recall``."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _sketches(trees: int, prefix: int):
    """Arrow function: (doc_id, digest, nodes) per row; nodes = id of the trie node at the prefix, per tree."""
    n = trees * prefix
    factor = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    shift = mix(np.arange(n + 1, 2 * n + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in slices(batch.column(1)):
                value, owner = shingles(Words(data, offsets), WIDTH)
                digest, full, first = _digests(value, owner, end - row)
                nodes = np.zeros((len(first), trees), np.uint64)
                for t in range(trees if len(first) else 0):
                    for k in range(t * prefix, (t + 1) * prefix):
                        least = np.minimum.reduceat(value * factor[k] + shift[k], first)
                        nodes[:, t] = mix(nodes[:, t] + least + np.uint64(t))
                lists = np.zeros(end - row + 1, np.int32)
                lists[1:] = np.cumsum(full) * trees
                yield pa.record_batch(
                    [
                        batch.column(0).slice(row, end - row),
                        pa.array(digest.view(np.int64), mask=~full),
                        pa.ListArray.from_arrays(pa.array(lists), pa.array(nodes.reshape(-1).view(np.int64))),
                    ],
                    ["doc_id", "digest", "nodes"],
                )

    return run


def _digests(value: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest of each row's set of shingles, which rows have any, and where those rows' shingles start."""
    counts = np.bincount(owner, minlength=n)
    full = counts > 0
    first = (np.cumsum(counts) - counts)[full]
    order = np.lexsort((value, owner))
    ordered = value[order]
    fresh = np.ones(len(ordered), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    fresh[first] = True
    digest = np.zeros(n, np.uint64)
    if len(first):
        spread = mix(ordered * np.uint64(0xD1342543DE82EF95) + np.uint64(0x632BE59BD9B4E019))
        digest[full] = mix(np.add.reduceat(np.where(fresh, spread, np.uint64(0)), first))
    return digest, full, first


def sketch(docs: DataFrame, trees: int = TREES, prefix: int | None = None) -> DataFrame:
    """(doc_id, digest, nodes) per row of ``docs``; digest is null for a text without words."""
    run = _sketches(trees, prefix or prefix_length(trees=trees))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, digest long, nodes array<long>")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted distinct shingles of each row as bytes, kept where the text still has the digest asked for."""
    for batch in batches:
        for row, end, data, offsets in slices(batch.column("text")):
            part = batch.slice(row, end - row)
            value, owner = shingles(Words(data, offsets), WIDTH)
            digest, full, _ = _digests(value, owner, end - row)
            bounds = np.searchsorted(owner, np.arange(end - row + 1))
            keep = np.flatnonzero(full & (digest.view(np.int64) == part.column("digest").to_numpy(zero_copy_only=False)))
            sets = [np.unique(value[bounds[k] : bounds[k + 1]]).tobytes() for k in keep]
            part = part.take(pa.array(keep))
            yield pa.record_batch(
                [*(part.column(c) for c in ("digest", "cell", "blocks", "weight")), pa.array(sets, pa.binary())],
                ["digest", "cell", "blocks", "weight", "shingles"],
            )


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the digest of each text as a further column ``__digest``."""
    for batch in batches:
        for row, end, data, offsets in slices(batch.column("text")):
            digest, full, _ = _digests(*shingles(Words(data, offsets), WIDTH), end - row)
            part = batch.slice(row, end - row)
            yield pa.record_batch([*part.columns, pa.array(digest.view(np.int64), mask=~full)], [*part.schema.names, "__digest"])


def _unnamed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a doc_id, and their digests."""
    return docs.where("doc_id IS NULL").mapInArrow(_with_digest, StructType([*docs.schema.fields, StructField("__digest", LongType())]))


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Number of common members of each pair of sets."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    both = np.zeros((n, n), np.int64)
    values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = counts[column] > 1
    place = np.cumsum(counts > 1) - 1
    column, owner = place[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = int(place[-1]) + 1 if len(values) else 0
    for lo in range(0, total, _COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + _COLUMNS])
        hot = np.zeros((n, min(_COLUMNS, total - lo)), np.float32)
        hot[owner[a:b], column[a:b] - lo] = 1
        both += (hot @ hot.T).astype(np.int64)
    np.fill_diagonal(both, sizes)
    return both


def _compare(group: list[tuple], low: int, high: int, threshold: float) -> list[tuple[int, int, int]]:
    """(digest, weight of its links, smallest digest linked to it here) for the classes of a pair of blocks."""
    seen = {row[0]: row for row in group}
    digests = np.array(sorted(seen), np.int64)
    rows = [seen[d] for d in digests.tolist()]
    sets = [np.frombuffer(r[3], np.uint64) for r in rows]
    block, weight = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.int64)
    both = _overlaps(sets)
    sizes = np.diag(both)
    linked = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
    np.fill_diagonal(linked, False)
    if low != high:
        linked &= block[:, None] != block[None, :]
    label = np.arange(len(rows))
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], len(rows)).min(axis=1))
        least = least[least]
        if (least == label).all():
            break
        label = least
    n = linked @ weight
    return [(int(d), int(k), int(digests[m])) for d, k, m in zip(digests, n, label, strict=True) if k]


def _verify(threshold: float):
    """Arrow function over rows sorted by (cell, low, high): compares each such group as it passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        key = None
        out: list[tuple[int, int, int]] = []

        def packed() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], ["digest", "links", "label"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("cell", "low", "high", "digest", "block", "weight", "shingles")]
            for cell, low, high, *row in zip(*columns, strict=True):
                if (cell, low, high) != key:
                    if len(group) > 1:
                        out += _compare(group, key[1], key[2], threshold)
                    group, key = [], (cell, low, high)
                group.append(tuple(row))
            if out:
                yield packed()
                out.clear()
        if len(group) > 1:
            out += _compare(group, key[1], key[2], threshold)
        if out:
            yield packed()

    return run


def _groups(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest (class), component (smallest digest of its group), class_id, n_links.

    A class is read by its smallest doc_id, or by its digest if no row of it has a doc_id. Only digests, node ids and counts are shuffled for all documents;
    shingle sets only for one document of each class that meets another.
    """
    prefix = prefix_length(threshold, trees, DEPTH, recall)
    rows = stage(sketch(docs, trees, prefix), "sketches")
    reps = rows.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("weight"), F.min("nodes").alias("nodes")
    )
    reps = stage(reps, "classes")
    nodes = reps.select("digest", F.posexplode("nodes").alias("tree", "node"))
    met = nodes.groupBy("tree", "node").agg(F.min("digest").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    links = nodes.join(met, ["tree", "node"]).select("digest", "least").where("digest != least")
    cells = stage(connected(links, "digest", "least"), "cells")
    sizes = cells.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = (
        cells.join(sizes, "component").withColumnRenamed("vertex", "digest").withColumnRenamed("component", "cell")
        .join(reps.select("digest", "rep", "weight"), "digest")
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(members, "rep")
    unnamed = (
        _unnamed(docs.select("doc_id", "text")).withColumnRenamed("__digest", "digest")
        .join(members.where("rep IS NULL").select("digest", "cell", "blocks", "weight"), "digest").dropDuplicates(["digest"])
    )
    texts = texts.select("digest", "cell", "blocks", "weight", "text").unionByName(unnamed.select("digest", "cell", "blocks", "weight", "text"))
    sets = texts.select("digest", "cell", "blocks", "weight", "text").mapInArrow(
        _sets, "digest long, cell long, blocks int, weight long, shingles binary"
    )
    block = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    dealt = sets.select(
        "cell", "digest", "weight", "shingles", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select("cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "digest", "block", "weight", "shingles")
    found = stage(
        dealt.repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high")
        .mapInArrow(_verify(threshold), "digest long, links long, label long"),
        "verified",
    )
    counts = found.groupBy("digest").agg(F.sum("links").alias("links"))
    groups = connected(found, "digest", "label")
    labelled = (
        reps.select("digest", "rep", "weight").join(groups.withColumnRenamed("vertex", "digest"), "digest", "left").join(counts, "digest", "left")
        .withColumn("component", F.coalesce("component", "digest"))
    )
    least = labelled.groupBy("component").agg(F.min("rep").alias("class_id"))
    classes = labelled.join(least, "component").select(
        "digest", "component", "class_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    )
    return rows.select("doc_id", "digest").join(classes, "digest", "left").select(
        "doc_id", "digest", "component", F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def join(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest (class), class_id, n_links.

    ``class_id`` is the smallest doc_id of the group that links at the threshold connect, ``n_links`` the number of
    other rows whose similarity reaches it.
    """
    return _groups(docs, threshold, trees, recall).drop("component")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group of near copies: that of the smallest doc_id.

    Texts without words are no copies of one another and all stay. Of rows with the same doc_id and text one
    stays; rows with the same doc_id and other texts stay or go together. A row without a doc_id stays only where no row
    of its group has one; then one of the class of the smallest digest stays.
    """
    grouped = stage(_groups(docs, threshold), "grouped")
    kept = grouped.where("doc_id = class_id").select(F.col("doc_id").alias("__kept")).distinct()
    found = docs.join(kept, F.col("doc_id") == F.col("__kept"), "left_semi")
    copy = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0)))
    has_words = F.coalesce("text", F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    found = found.withColumn("__copy", copy).where((F.col("__copy") == 1) | ~has_words).select(*docs.columns)
    unnamed = _unnamed(docs)
    alone = grouped.where("doc_id IS NULL AND class_id IS NULL AND digest = component").select(F.col("digest").alias("__digest")).distinct()
    single = unnamed.join(alone, "__digest", "left_semi").dropDuplicates(["__digest"])
    return found.unionByName(single.select(*docs.columns)).unionByName(unnamed.where("__digest IS NULL").select(*docs.columns))


# All pairs that share a shingle, then everything that links reach.
_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING count(*) >= 0.8 * (x.n + y.n - count(*)) - 1e-9),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, p.b FROM reach JOIN p ON p.a = reach.b)
SELECT r.a AS doc_id, r.class_id, coalesce(l.n, 0) AS n_links FROM (SELECT a, min(b) AS class_id FROM reach GROUP BY a) r
LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY a) l ON l.a = r.a
"""


@query("op2_jaccard_forest", _SQL)
def op2_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir)).drop("digest")
