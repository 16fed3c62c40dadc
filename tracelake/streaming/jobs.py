"""Structured Streaming jobs: request latency, service-level board, concurrency, prefix locality, sinks.

Event-time columns must be TIMESTAMP (cast NTZ columns under session time zone UTC first). The
jobs with custom state need the RocksDB state store (``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tracelake.functions import scoring
from tracelake.functions.text import normalize_text, words
from tracelake.operators.ordered import null_safe_join, ordered_scan, time_chunk
from tracelake.operators.quantiles import _bucket
from tracelake.session import ROCKSDB
from tracelake.sources.readers import path_exists

# Prefixes a worker remembers, tokens a warm prefix saves.
PREFIX_HISTORY, PREFIX_BONUS_TOKENS = 64, 500.0
# Batches between two snapshots of a stored update stream.
SNAPSHOT_EVERY = 16


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


# Request latency

COLLECTED = "request_id string, ttft_ms double, gaps array<double>, output_tokens long, latency_ms double, error string"


# Requests are dealt to so many buckets; a bucket's events in a batch are worked on together and its state is read once.
LATENCY_BUCKETS = 1024


class RequestLatency(StatefulProcessor):
    """Collects the events of each request until its end or the timeout, then emits one row; a key is a bucket of requests.

    A reported request leaves a mark, so that events that come after its end are not taken for another request. The mark goes
    when the watermark is a timeout past the last event seen, and with it nothing of the request is left.
    """

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getValueState(
            "events", "request_id array<string>, seq array<int>, us array<long>, kind array<string>, due_ms array<long>"
        )
        self.reported = handle.getValueState("reported", "request_id array<string>, until_ms array<long>")

    def _load(self) -> tuple[pd.DataFrame, dict]:
        """Events of open requests, each with the time its request waits for, and the marks."""
        stored = self.events.get() if self.events.exists() else ([],) * 5
        marks = dict(zip(*self.reported.get())) if self.reported.exists() else {}
        return pd.DataFrame(dict(zip(["request_id", "seq", "us", "kind", "due_ms"], map(list, stored)))), marks

    def _save(self, events: pd.DataFrame, marks: dict) -> None:
        """Stores both and leaves one timer, for whatever ends first."""
        if len(events):
            self.events.update(tuple(events[c].tolist() for c in ("request_id", "seq", "us", "kind", "due_ms")))
        else:
            self.events.clear()
        if marks:
            self.reported.update((list(marks), list(marks.values())))
        else:
            self.reported.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        ends = [*events["due_ms"].tolist(), *marks.values()]
        if ends:
            self.handle.registerTimer(int(min(ends)))

    @staticmethod
    def _rows(events: pd.DataFrame, error: str | None) -> pd.DataFrame:
        """One row per request of ``events``."""
        e = events.sort_values(["request_id", "seq", "us", "kind"], ignore_index=True)
        code, ids = pd.factorize(e["request_id"], use_na_sentinel=False)
        us, kind = e["us"].to_numpy("int64"), e["kind"].to_numpy()
        first = np.searchsorted(code, np.arange(len(ids)))
        begin, last = us[first], us[np.append(first[1:], len(us)) - 1]
        starts = np.flatnonzero(kind == "start")[::-1]
        begin[code[starts]] = us[starts]
        tokens = np.flatnonzero(kind == "token")
        n = np.bincount(code[tokens], minlength=len(ids))
        at = np.cumsum(n) - n
        ttft = np.full(len(ids), np.nan)
        ttft[n > 0] = (us[tokens[at[n > 0]]] - begin[n > 0]) / 1000.0
        steps = np.diff(us[tokens]) / 1000.0
        errors = np.full(len(ids), error, dtype=object)
        errors[code[kind == "error"]] = "error"
        return pd.DataFrame(
            {
                "request_id": ids, "ttft_ms": ttft, "gaps": [steps[a : a + max(k - 1, 0)] for a, k in zip(at.tolist(), n.tolist())],
                "output_tokens": n, "latency_ms": (last - begin) / 1000.0, "error": errors,
            }
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)[["request_id", "seq", "us", "kind"]]
        events, marks = self._load()
        by_id = new.groupby("request_id", dropna=False, sort=False)["us"]
        until = dict(zip(new["request_id"], by_id.transform("max") // 1000 + self.timeout_ms))
        late = new["request_id"].isin(list(marks))
        for i in new.loc[late, "request_id"].unique():
            marks[i] = max(marks[i], until[i])
        waits = dict(zip(events["request_id"], events["due_ms"]))
        due = by_id.transform("min") // 1000 + self.timeout_ms
        new["due_ms"] = [waits.get(i, d) for i, d in zip(new["request_id"], due)]
        new = new[~late]
        ended = new.loc[new["kind"].isin(["done", "error"]), "request_id"].unique()
        events = pd.concat([events, new], ignore_index=True) if len(events) else new
        done = events["request_id"].isin(ended)
        if len(ended):
            yield self._rows(events[done], None)
            marks |= {i: until[i] for i in ended}
        self._save(events[~done], marks)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        events, marks = self._load()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        marks = {i: t for i, t in marks.items() if t > now}
        out = events["due_ms"] <= now
        if out.any():
            yield self._rows(events[out], "timeout")
            marks |= {i: t + self.timeout_ms for i, t in zip(events.loc[out, "request_id"], events.loc[out, "due_ms"])}
        self._save(events[~out], marks)

    def close(self) -> None:
        pass


def request_latency_stream(events: DataFrame, timeout_s: int, delay: str = "10 minutes") -> DataFrame:
    """Token events (request_id, event_ts, seq, kind) to one latency row per finished request."""
    src = events.withWatermark("event_ts", delay).select(
        F.pmod(F.xxhash64("request_id"), F.lit(LATENCY_BUCKETS)).alias("bucket"), F.col("request_id").cast("string").alias("request_id"), "event_ts",
        F.col("seq").cast("int").alias("seq"), F.unix_micros("event_ts").alias("us"), "kind",
    )
    collected = src.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=RequestLatency(timeout_s * 1000), outputStructType=COLLECTED, outputMode="Append", timeMode="EventTime"
    )
    tbt = scoring.trimmed_median(F.col("gaps")).alias("tbt_ms")
    return collected.select("request_id", "ttft_ms", tbt, "output_tokens", "latency_ms", "error")


def request_latency_batch(events: DataFrame) -> DataFrame:
    """The same figures over stored events, with ordered scans and no per-request state."""
    us = F.unix_micros("event_ts")
    d = events.withColumn("us", us)
    ends = d.groupBy("request_id").agg(
        F.min(F.when(F.col("kind") == "start", F.col("us"))).alias("s"), F.min("us").alias("lo"), F.max_by("us", "seq").alias("hi"),
        F.min(F.when(F.col("kind") == "token", F.col("us"))).alias("t"), F.count_if(F.col("kind") == "token").alias("output_tokens"),
        F.max(F.when(F.col("kind") == "error", "error")).alias("error"),
    )
    begin = F.coalesce("s", "lo")
    base = ends.select(
        "request_id", ((F.col("t") - begin) / 1000.0).alias("ttft_ms"), "output_tokens", ((F.col("hi") - begin) / 1000.0).alias("latency_ms"), "error"
    )
    tok = d.filter("kind = 'token'").select("request_id", "seq", "us", "event_ts")
    tok = ordered_scan(tok, ["request_id"], ["seq"], time_chunk(F.col("event_ts")), lags={"p": F.col("us")})
    gaps = tok.filter("p IS NOT NULL").select("request_id", "seq", ((F.col("us") - F.col("p")) / 1000.0).alias("gap"))
    ranked = ordered_scan(gaps, ["request_id"], ["gap", "seq"], _bucket(F.col("gap")), rank="r", total="n")
    trim = F.greatest(F.lit(1), F.floor(F.col("n") * 0.05))
    trim = F.when(F.col("n") - 2 * trim > 0, trim).otherwise(F.lit(0))
    m = F.col("n") - 2 * trim
    at = F.col("r") - trim
    mid = (at == F.floor((m + 1) / 2)) | (at == F.floor(m / 2) + 1)
    med = ranked.filter(mid & (F.col("n") >= 2)).groupBy("request_id").agg(F.mean("gap").alias("tbt_ms"))
    return base.join(med, "request_id", "left").select("request_id", "ttft_ms", "tbt_ms", "output_tokens", "latency_ms", "error")


# Windowed boards


def slo_board_stream(
    metrics: DataFrame, ts: str, by: str, window: str, slo_ttft: float, slo_tbt: float, delay: str = "1 hour", accuracy: int | None = 10_000
) -> DataFrame:
    """Counts, effective rate and TTFT percentiles per workload and tumbling window.

    ``accuracy=None`` keeps every value of an open window for exact percentiles.
    """
    def at(p: float) -> Column:
        return F.percentile("ttft_ms", p) if accuracy is None else F.approx_percentile("ttft_ms", p, accuracy)

    live = metrics.filter(~F.col("is_warmup")).withWatermark(ts, delay)
    ok = scoring.request_effective(F.col("ttft_ms"), F.col("tbt_ms"), F.col("output_tokens"), F.lit(slo_ttft), F.lit(slo_tbt))
    g = live.groupBy(F.window(ts, window).alias("w"), by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_effective"),
        F.count_if(scoring.slo_violation(F.col("ttft_ms"), F.lit(slo_ttft))).alias("slo_fail_ttft"),
        at(0.5).alias("p50"), at(0.95).alias("p95"),
    )
    return g.select(F.col("w.start").alias("window_start"), by, "n", "n_effective", (F.col("n_effective") / F.col("n")).alias("erc"), "slo_fail_ttft", "p50", "p95")


def concurrency_stream(trace: DataFrame, ts: str, bucket: str, delay: str = "1 hour") -> DataFrame:
    """Starts per time bucket; the maximum is taken over the stored result."""
    g = trace.withWatermark(ts, delay).groupBy(F.window(ts, bucket).alias("w")).agg(F.count(F.lit(1)).alias("starts"))
    return g.select(F.col("w.start").alias("bucket_start"), "starts")


def load_stream(
    events: DataFrame, path: str, checkpoint: str, worker: str, order: Sequence[str], chunk: Column, delta: str, tokens: str
) -> StreamingQuery:
    """In-flight requests and queued tokens per worker, floored at 0 after every event; current rows by ``latest_updates``.

    A batch reads the last snapshot of all workers and the updates since, at most ``SNAPSHOT_EVERY`` batches, so it costs the same
    however many came before.

    A batch is reduced per worker to the sum and the lowest running sum of its events, in order, by the scan that
    spreads a busy worker over tasks. From a start ``x`` the floored value is then ``max(x + sum, sum - lowest)``.
    """
    columns = {"inflight": delta, "queued_tokens": tokens}

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = ordered_scan(batch, [worker], list(order), chunk, sums={f"__{c}": F.col(v) for c, v in columns.items()})
        net = run.groupBy(worker).agg(
            *[F.sum(v).alias(f"sum_{c}") for c, v in columns.items()], *[F.min(f"__{c}").alias(f"low_{c}") for c in columns]
        )
        old = _rows_before(spark, path, batch_id)
        if old is not None:
            old = _current(old, [worker])
            net = null_safe_join(net, old, [worker], "left")
        else:
            net = net.withColumns({c: F.lit(0).cast("long") for c in columns})
        after = [
            F.greatest(F.coalesce(c, F.lit(0)) + F.col(f"sum_{c}"), F.col(f"sum_{c}") - F.col(f"low_{c}"), F.lit(0)).cast("long").alias(c)
            for c in columns
        ]
        net.select(worker, *after).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        if batch_id % SNAPSHOT_EVERY == 0:
            now = spark.read.parquet(f"{path}/batch_id={batch_id}").withColumn("batch_id", F.lit(batch_id))
            now = now if old is None else now.unionByName(old.withColumn("batch_id", F.lit(-1)))
            _current(now, [worker]).write.mode("overwrite").parquet(f"{path}_snapshots/{batch_id}")

    return events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _rows_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """The rows of the last snapshot before a batch and of the batches between; None where nothing was written."""
    last = (batch_id - 1) // SNAPSHOT_EVERY * SNAPSHOT_EVERY
    parts = [spark.read.parquet(f"{path}/batch_id={k}").withColumn("batch_id", F.lit(k)) for k in range(max(last + 1, 0), batch_id)]
    if last >= 0 and path_exists(spark, f"{path}_snapshots/{last}"):
        parts.append(spark.read.parquet(f"{path}_snapshots/{last}").withColumn("batch_id", F.lit(last)))
    return reduce(DataFrame.unionByName, parts) if parts else None


# Prefix locality


class PrefixHistory(StatefulProcessor):
    """Last distinct prefixes of a worker, oldest first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "prefix string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("pos")
        recent = dict.fromkeys(p for (p,) in self.recent.get())
        hits = []
        for prefix in new["prefix_hash"]:
            hits.append(bool(prefix) and prefix in recent)
            if prefix:
                recent.pop(prefix, None)
                recent[prefix] = None
                if len(recent) > PREFIX_HISTORY:
                    del recent[next(iter(recent))]
        self.recent.put([(p,) for p in recent])
        yield pd.DataFrame({"worker_id": key[0], "pos": new["pos"].to_numpy(), "hit": hits})

    def close(self) -> None:
        pass


def prefix_hits_stream(routed: DataFrame) -> DataFrame:
    """Hit flag per routed request (worker_id, pos, prefix_hash): was the prefix among the worker's last 64?"""
    src = routed.select("worker_id", F.col("pos").cast("long").alias("pos"), "prefix_hash")
    return src.groupBy("worker_id").transformWithStateInPandas(
        statefulProcessor=PrefixHistory(), outputStructType="worker_id string, pos long, hit boolean", outputMode="Append", timeMode="None"
    )


def prefix_bonus(hit: Column, prefill_tps: Column) -> Column:
    return F.when(hit, F.lit(PREFIX_BONUS_TOKENS) / prefill_tps).otherwise(F.lit(0.0))


# Enrichment and sinks


def row_token_f1(prediction: Column, reference: Column) -> Column:
    """Token F1 inside one row, for short texts of a stream."""
    p, r = words(normalize_text(prediction)), words(normalize_text(reference))

    def times(a: Column, t: Column) -> Column:
        return F.size(F.filter(a, lambda x: x == t))

    hits = F.aggregate(F.array_intersect(p, r), F.lit(0), lambda acc, t: acc + F.least(times(p, t), times(r, t)))
    return (
        F.when((F.size(p) == 0) & (F.size(r) == 0), F.lit(1.0)).when(hits == 0, F.lit(0.0)).otherwise(2.0 * hits / (F.size(p) + F.size(r)))
    )


def enrich_stream(metrics: DataFrame, slo: DataFrame, slo_key: str, probes: DataFrame | None = None) -> DataFrame:
    """Stream-static joins: limits per ``slo_key`` (slo_ttft_ms, slo_tbt_ms) and reference answers per request."""
    d = metrics.join(slo, slo_key, "left")
    d = d.withColumn(
        "effective",
        scoring.request_effective(
            F.col("ttft_ms"), F.col("tbt_ms"), F.col("output_tokens"), F.col("slo_ttft_ms"), F.col("slo_tbt_ms")
        ),
    )
    if probes is not None:
        d = d.join(probes.select("request_id", "reference_answer"), "request_id", "left")
        d = d.withColumn("probe_f1", F.when(F.col("reference_answer").isNotNull(), row_token_f1(F.col("completion"), F.col("reference_answer"))))
    return d


def persist_stream(df: DataFrame, path: str, checkpoint: str, key: str, ts: str, delay: str | None = None) -> StreamingQuery:
    """Append each request once, however late it is repeated; the checkpoint makes restarts exact.

    The keys seen stay in the state store (``use_rocksdb``), spread by key; a batch looks up its own keys only. With ``delay`` a key is forgotten once
    the watermark is past it by so much, and a later repeat is stored again.
    """
    unique = df.dropDuplicates([key]) if delay is None else df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
    return (
        unique.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def append_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def update_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Store every update under its batch number; a repeated batch overwrites itself."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        df.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    )


def latest_updates(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Current row per key of a stored update stream."""
    return _current(spark.read.option("basePath", path).parquet(path), keys)


def _current(d: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in d.columns if c not in (*keys, "batch_id")]
    g = d.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("__s"))
    return g.select(*keys, "__s.*")
