"""Importance resampling towards a target distribution: weights from hashed features, drawn by rank of perturbed weights.

Texts are bags of features (runs of words) in hashed buckets. Two counts, over all documents and over all target texts, give
each bucket a gain: the log ratio of its shares. The gains are one array; a document's weight is the mean over its
features. Adding seeded Gumbel noise to the weights and taking the highest is drawing without replacement in proportion
to them. The draw ranks documents by (score, smaller doc_id) with a distributed radix sort (``radix_sort``), so no task and
no driver ever holds them; only rows of four numbers are shuffled, never texts.

Texts are read twice, once to count and once to weigh. Each task of the count sends at most one row per bucket.

Defined cases: a null or empty text has no features and weight 0; a text of any length is read whole, in slices of about a
megabyte of words unless it is longer itself; a null doc_id is written as no characters in the noise and comes last among
ties; rows with the same doc_id share their noise, and of equal scores the one with fewer features comes first; repeated rows
are drawn each; an empty table gives an empty result; with an empty target all gains follow from the documents alone;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.catalog import documents, query
from tracelake.llm.radix_sort import positions
from tracelake.llm.wordbytes import LOWER, NOT_ALNUM, Words, slices
from tracelake.session import stage

BUCKETS = 10_000
SEED = "2024"
_LONG_WORD = 48


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _crc_words(state: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 registers after one more word each; words over ``_LONG_WORD`` bytes go to zlib one by one."""
    state = state.copy()
    order = np.argsort(-np.minimum(length, _LONG_WORD + 1).astype(np.int16), kind="stable")
    long_ = int(np.count_nonzero(length > _LONG_WORD))
    for k in order[:long_].tolist():
        state[k] = zlib.crc32(data[start[k] : start[k] + length[k]].tobytes(), int(state[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    order = order[long_:]
    alive = len(order) - np.searchsorted(length[order][::-1], np.arange(_LONG_WORD), side="right")  # words longer than each number
    register, first = state[order], start[order]
    for at in range(_LONG_WORD):
        n = int(alive[at])
        if not n:
            break
        register[:n] = _CRC[(register[:n] ^ data[first[:n] + at]) & np.uint32(255)] ^ (register[:n] >> np.uint32(8))
    state[order] = register
    return state


def features(data: np.ndarray, offsets: np.ndarray, most_words: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and row of every feature of a slice of texts, and the number of words of each row."""
    data = LOWER[data]
    words = Words(data, offsets, NOT_ALNUM)
    length = words.end - words.start
    ends = words.row_start[1:][words.row]
    state = np.full(len(words), 0xFFFFFFFF, np.uint32)
    first = np.arange(len(words))
    found, rows = [], []
    for n in range(most_words):
        keep = first + n < ends[first]
        first, state = first[keep], state[keep]
        if n:
            state = _CRC[(state ^ np.uint32(0x20)) & np.uint32(255)] ^ (state >> np.uint32(8))
        state = _crc_words(state, data, words.start[first + n], length[first + n])
        found.append((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets))
        rows.append(words.row[first])
    return np.concatenate(found).astype(np.int64), np.concatenate(rows), np.diff(words.row_start)


def bucket_counts(texts: DataFrame, most_words: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                counts += np.bincount(features(data, offsets, most_words, buckets)[0], minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(used), pa.array(counts[used])], ["bucket", "n"])

    total = np.zeros(buckets, np.int64)
    summed = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for row in summed.collect():  # at most one row per bucket
        total[row["bucket"]] = row["n"]
    return total


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, target over raw."""
    k = len(raw)
    s_all, t_all = int(raw.sum()), int(target.sum())
    return np.array(
        [math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)],
        np.int64,
    )


def weigh(docs: DataFrame, gains: np.ndarray, most_words: int = 1) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in slices(batch.column("text")):
                bucket, at, n_words = features(data, offsets, most_words, len(gains))
                n = np.bincount(at, minlength=end - row)
                total = np.zeros(end - row, np.int64)
                np.add.at(total, at, gains[bucket])
                yield pa.record_batch(
                    [batch.column("doc_id").slice(row, end - row), pa.array(n_words.astype(np.int64)), pa.array(n), pa.array(total // np.maximum(n, 1))],
                    ["doc_id", "n_words", "n_features", "weight"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, most_words: int = 1, buckets: int = BUCKETS, seed: str = SEED, **sort,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; the rank is null where the row is not drawn."""
    gains = bucket_gains(bucket_counts(docs, most_words, buckets), bucket_counts(target, most_words, buckets))
    noise_hash = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((noise_hash + 0.5) / 4294967296.0)))
    scored = stage(weigh(docs, gains, most_words).withColumn("score", F.col("weight") + noise), "weights")
    eligible = F.col("n_words") >= least_words
    columns = ["doc_id", "n_features", "weight", "score"]
    pool = scored.where(eligible).select(*columns)
    drawn = percent * pool.count() // 100
    ranked = positions(pool, [("score", True), ("doc_id", False), ("n_features", False)], **sort)
    ranked = ranked.select(*columns, F.when(F.col("position") < drawn, F.col("position") + 1).alias("rank"))
    return ranked.unionByName(scored.where(~eligible).select(*columns, F.lit(None).cast("long").alias("rank")))


_SQL = """
WITH RECURSIVE crc_bits AS (
  SELECT b::BIGINT AS b, 0 AS step, b::BIGINT AS c FROM range(256) t(b)
  UNION ALL
  SELECT b, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_bits WHERE step < 8
),
crc_table AS (SELECT list(c ORDER BY b) AS tab FROM crc_bits WHERE step = 8),
doc_words AS (
  SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
),
doc_features AS (SELECT k, unnest(words) AS w FROM doc_words),
target_features AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w
  FROM benchmark
),
vocabulary AS (SELECT DISTINCT w FROM (SELECT w FROM doc_features UNION ALL SELECT w FROM target_features)),
bytes AS (SELECT w, list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(w), (2 * i + 1)::INT, 2))::BIGINT) AS bs FROM vocabulary),
buckets AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, bs), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes, crc_table
),
raw AS (SELECT bucket, count(*) AS n FROM doc_features JOIN buckets USING (w) GROUP BY bucket),
goal AS (SELECT bucket, count(*) AS n FROM target_features JOIN buckets USING (w) GROUP BY bucket),
sizes AS (SELECT (SELECT count(*) FROM doc_features)::DOUBLE AS s_all, (SELECT count(*) FROM target_features)::DOUBLE AS t_all),
gains AS (
  SELECT raw.bucket, floor(1000 * ln((coalesce(goal.n, 0) + 1) * (s_all + 10000) / ((raw.n + 1) * (t_all + 10000))))::BIGINT AS gain
  FROM raw LEFT JOIN goal USING (bucket), sizes
),
sums AS (SELECT k, sum(gain) AS total FROM doc_features JOIN buckets USING (w) JOIN gains USING (bucket) GROUP BY k),
weighed AS (
  SELECT k, doc_id, len(words)::BIGINT AS n_features, floor(coalesce(total, 0)::DOUBLE / greatest(len(words), 1))::BIGINT AS weight,
    ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM doc_words LEFT JOIN sums USING (k)
),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM weighed),
ranked AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS r FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * (SELECT count(*) FROM ranked) // 100 THEN r END AS rank
FROM scored LEFT JOIN ranked USING (k)
"""


@query("op12_importance_resampling", _SQL)
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
