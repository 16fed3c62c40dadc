"""Product codes of vectors: codebooks by Lloyd rounds, in which cover trees assign whole subtrees at once.

Vectors become integers (``floor(scale * x)``), are cut into ``parts`` consecutive pieces, and each piece position gets a codebook.
Every slice of a partition (at most ``SLICE_ROWS`` vectors) has one cover tree per position, built once and written to the
shared folder: a node has a point as its center, all points of its subtree within its radius, and children whose centers lie
more than half that radius apart and cover it; the center is itself the first child's. Points of a subtree stand together, so the
difference of two cumulative sums is the sum of a subtree.

A round sends the codebooks (``parts`` x ``entries`` integer vectors) to the tasks. With ``d`` the distance of a center to its
nearest entry and ``r`` the radius, an entry further than ``d + 2 r`` from the center is nearest to no point of the subtree; where that
rules out all others, the subtree goes to the nearest entry whole, by its sum and count. Other nodes hand over to their
children, and points of ambiguous leaves are compared exactly. Tasks return sums per entry, which Spark adds up; the
driver sees one number per component of the codebooks.

Squared distances are exact: integers whose sums of squares stay below 2^53 are compared in double precision, larger ones
are compared with a margin and, inside it, as Python integers. Sums are added in limbs of 24 bits, so they cannot overflow.

Defined cases: a null vector, one with a null or non-finite component or one of more than 1e150, and one whose length is not the
most frequent length (of ties the longer) is dropped; parts of a length that ``parts`` does not divide differ by one, longer ones
first; a null vec_id comes after all others, rows that share one in order of their vectors, repeated rows count each; with fewer
rows than entries the codebooks are shorter; an empty table gives an empty result; errors beyond a long stay at its maximum; labels
are compared as text; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.catalog import query
from tracelake.session import stage

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
SLICE_ROWS = 4096
SLICE_BYTES = 4 << 20
LEAF_ROWS = 24
_LIMB = 24
_LARGEST = (1 << 63) - 1
_BROADCAST_LABELS = 100_000
_SLICE = "vec_id array<long>, label array<string>, trees binary"


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and the scaled components ``q`` (not yet floored) of the rows that are kept."""
    q = F.transform("embedding", lambda x: x.cast("double") * F.lit(float(scale)))
    usable = F.forall("q", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= F.lit(1e150)))
    label = F.col("label").cast("string") if "label" in vectors.columns else F.lit(None).cast("string")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), q.alias("q")).where(F.col("q").isNotNull() & usable)
    length = rows.groupBy(F.size("q").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size("q") == (length["size"] if length else -1))


def cut(n: int, parts: int) -> list[slice]:
    """Component range of each part."""
    ends = np.cumsum([0] + [n // parts + (k < n % parts) for k in range(parts)]).tolist()
    return [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def build_tree(x: np.ndarray, leaf_rows: int = LEAF_ROWS) -> dict[str, np.ndarray]:
    """Cover tree of the rows of ``x``: ``order`` of the rows, and per node center, [low, high) in that order, radius and children."""
    order = np.arange(len(x))
    from_center = np.sqrt(((x - x[0]) ** 2).sum(1))
    center, low, high, radius, child, children = [0], [0], [len(x)], [from_center.max()], [0], [0]
    node = 0
    while node < len(center):
        a, b, r = low[node], high[node], radius[node]
        if r > 0 and b - a > leaf_rows:
            rows, away = order[a:b].copy(), from_center[a:b].copy()
            near, k, at = away <= r / 2, center[node], a
            child[node] = len(center)
            while True:
                own, own_away = rows[near], away[near]
                end = at + len(own)
                order[at:end], from_center[at:end] = own, own_away
                for values, v in ((center, k), (low, at), (high, end), (radius, own_away.max()), (child, 0), (children, 0)):
                    values.append(v)
                children[node] += 1
                at, rows = end, rows[~near]
                if not len(rows):
                    break
                k = rows[0]
                away = np.sqrt(((x[rows] - x[k]) ** 2).sum(1))
                near = away <= r / 2
        node += 1
    ints = {"order": order, "center": center, "low": low, "high": high, "child": child, "children": children}
    return {**{k: np.array(v, np.int32) for k, v in ints.items()}, "radius": np.array(radius)}


class Codebook:
    """Entries of one part position, as integers."""

    def __init__(self, entries: list[list[int]]):
        self.entries = entries
        self.values = np.array(entries, np.float64).reshape(len(entries), -1)
        self.squares = (self.values**2).sum(1)
        self.most = max((abs(v) for e in entries for v in e), default=0)

    def nearest(self, x: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest entry of each row (ties to the lower index), its squared distance, and that of the nearest other entry."""
        near, first, second = np.empty(len(x), np.int64), np.empty(len(x)), np.full(len(x), np.inf)
        step = max(1, (1 << 20) // (len(self.values) * (1 if exact else max(1, x.shape[1]))))
        for lo in range(0, len(x), step):
            some = x[lo : lo + step]
            if exact:
                squared = (some**2).sum(1)[:, None] - 2 * (some @ self.values.T) + self.squares
            else:
                squared = ((some[:, None, :] - self.values) ** 2).sum(2)
            at, rows = squared.argmin(1), np.arange(len(some))
            if not exact:
                close = squared <= squared[rows, at][:, None] * (1 + 1e-9)
                for k in np.flatnonzero(close.sum(1) > 1).tolist():
                    at[k] = min(np.flatnonzero(close[k]).tolist(), key=lambda e: (self.distance(some[k], e), e))
            near[lo : lo + step], first[lo : lo + step] = at, squared[rows, at]
            if len(self.values) > 1:
                squared[rows, at] = np.inf
                second[lo : lo + step] = squared.min(1)
        return near, first, second

    def distance(self, row: np.ndarray, entry: int) -> int:
        return sum((int(v) - e) ** 2 for v, e in zip(row.tolist(), self.entries[entry], strict=True))


class Slice:
    """Vectors of a slice and the cover tree of each part."""

    def __init__(self, blob: bytes):
        with np.load(io.BytesIO(blob)) as arrays:
            got = dict(arrays)
        self.x = got.pop("x").astype(np.float64)
        self.most = np.abs(self.x).max(initial=0)
        self.trees: list[dict[str, np.ndarray]] = []
        for name, values in got.items():
            part, field = name.split("_", 1)
            while len(self.trees) <= int(part):
                self.trees.append({})
            self.trees[int(part)][field] = values
        self.ranges = cut(self.x.shape[1], len(self.trees))

    @staticmethod
    def pack(x: np.ndarray, parts: int) -> bytes:
        out = io.BytesIO()
        small = x.astype(np.int32) if np.abs(x).max(initial=0) < 1 << 31 else x
        trees = {f"{p}_{k}": v for p, at in enumerate(cut(x.shape[1], parts)) for k, v in build_tree(x[:, at]).items()}
        np.savez(out, x=small, **trees)
        return out.getvalue()

    def exact(self, part: int, book: Codebook) -> bool:
        """Whether double precision holds all squared distances."""
        return 4 * self.x[:, self.ranges[part]].shape[1] * int(max(self.most, book.most)) ** 2 < 1 << 53

    def assign(self, part: int, book: Codebook) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Entry of each row, rows per entry, and component sums per entry (None where only big integers hold them)."""
        tree, exact = self.trees[part], self.exact(part, book)
        order = tree["order"]
        x = self.x[order, self.ranges[part]]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        running = np.zeros((len(x) + 1, x.shape[1]))
        np.cumsum(x, axis=0, out=running[1:])
        codes, counts, sums = np.empty(len(x), np.int64), np.zeros(len(book.entries), np.int64), np.zeros((len(book.entries), x.shape[1]))
        open_, loose = np.zeros(1, np.int64), [np.zeros(0, np.int64)]
        while len(open_):
            low, high, radius = tree["low"][open_].astype(np.int64), tree["high"][open_].astype(np.int64), tree["radius"][open_]
            near, first, second = book.nearest(x[place[tree["center"][open_]]], exact)
            alike = (radius == 0) | (np.sqrt(second) > (np.sqrt(first) + 2 * radius) * (1 + 1e-6))
            codes[_runs(low[alike], high[alike])] = np.repeat(near[alike], (high - low)[alike])
            np.add.at(sums, near[alike], running[high[alike]] - running[low[alike]])
            leaf = ~alike & (tree["children"][open_] == 0)
            loose.append(_runs(low[leaf], high[leaf]))
            inner = open_[~alike & ~leaf]
            begin = tree["child"][inner].astype(np.int64)
            open_ = _runs(begin, begin + tree["children"][inner])
        rows = np.concatenate(loose)
        codes[rows] = book.nearest(x[rows], exact)[0]
        np.add.at(sums, codes[rows], x[rows])
        counts += np.bincount(codes, minlength=len(counts))
        return codes[place], counts, sums if exact else None


def _runs(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All integers of the ranges, one range after the other."""
    sizes = high - low
    return np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _slices(rows: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column("q")
            values = q.flatten().to_numpy()
            x = values.reshape(len(batch), len(values) // max(len(batch), 1))
            step = max(1, min(SLICE_ROWS, SLICE_BYTES // max(8 * x.shape[1], 1)))
            for lo in range(0, len(batch), step):
                ids, labels = (pa.array([batch.column(c).slice(lo, step).to_pylist()], t) for c, t in (("vec_id", pa.list_(pa.int64())), ("label", pa.list_(pa.string()))))
                yield pa.record_batch([ids, labels, pa.array([Slice.pack(np.floor(x[lo : lo + step]), parts)], pa.binary())], ["vec_id", "label", "trees"])

    return stage(rows.select("vec_id", "label", "q").mapInArrow(run, _SLICE), "cover-trees")


def _limbs(value: int) -> list[int]:
    out = []
    while value:
        low = value & ((1 << _LIMB) - 1) if value > 0 else -(-value & ((1 << _LIMB) - 1))
        out.append(low)
        value = (value - low) >> _LIMB
    return out


def _round(slices: DataFrame, books: list[Codebook]) -> list[Codebook]:
    """The codebooks after one assignment: floored means of the parts of each entry; entries without parts stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b.entries), np.int64) for b in books]
        totals = [[[0] * len(e) for e in b.entries] for b in books]
        sums = [np.zeros(b.values.shape, np.int64) for b in books]
        for batch in batches:
            for blob in batch.column("trees").to_pylist():
                own = Slice(blob)
                for p, book in enumerate(books):
                    codes, n, total = own.assign(p, book)
                    counts[p] += n
                    if total is not None:
                        sums[p] += total.astype(np.int64)
                        continue
                    for code, row in zip(codes.tolist(), own.x[:, own.ranges[p]].tolist(), strict=True):
                        totals[p][code] = [a + int(v) for a, v in zip(totals[p][code], row, strict=True)]
        out = [(p, e, -1, k, v) for p in range(len(books)) for e in range(len(counts[p])) for k, v in enumerate(_limbs(int(counts[p][e])))]
        for p, book in enumerate(books):
            for e in range(len(book.entries)):
                for i, (wide, narrow) in enumerate(zip(totals[p][e], sums[p][e].tolist(), strict=True)):
                    out += [(p, e, i, k, v) for k, v in enumerate(_limbs(wide + narrow))]
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["part", "entry", "at", "limb", "v"])

    summed = slices.select("trees").mapInArrow(run, "part int, entry int, at int, limb int, v long").groupBy("part", "entry", "at", "limb").agg(F.sum("v").alias("v"))
    total: dict[tuple[int, int, int], int] = {}
    for r in summed.collect():  # a few numbers per component of the codebooks
        key = (r["part"], r["entry"], r["at"])
        total[key] = total.get(key, 0) + (r["v"] << (_LIMB * r["limb"]))
    out = []
    for p, book in enumerate(books):
        means = []
        for e, old in enumerate(book.entries):
            n = total.get((p, e, -1), 0)
            means.append([total.get((p, e, i), 0) // n for i in range(len(old))] if n else old)
        out.append(Codebook(means))
    return out


def _final(slices: DataFrame, books: list[Codebook]) -> DataFrame:
    """vec_id, label, code and error of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, blob in zip(batch.column("vec_id"), batch.column("label"), batch.column("trees"), strict=True):
                own = Slice(blob.as_py())
                codes = [own.assign(p, book)[0] for p, book in enumerate(books)]
                error = [0] * len(own.x)
                for p, book in enumerate(books):
                    x = own.x[:, own.ranges[p]]
                    if own.exact(p, book):
                        part = ((x - book.values[codes[p]]) ** 2).sum(1).astype(np.int64).tolist()
                    else:
                        part = [book.distance(row, c) for row, c in zip(x, codes[p].tolist(), strict=True)]
                    error = [a + b for a, b in zip(error, part, strict=True)]
                digits = max(2, len(f"{max(len(b.entries) for b in books) - 1:x}"))
                text = ["".join(f"{c:0{digits}x}" for c in row) for row in zip(*[c.tolist() for c in codes], strict=True)]
                yield pa.record_batch(
                    [ids.values, labels.values, pa.array(text, pa.string()), pa.array([min(e, _LARGEST) for e in error], pa.int64())],
                    ["vec_id", "label", "code", "error"],
                )

    return stage(slices.mapInArrow(run, "vec_id long, label string, code string, error long"), "codes")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept vector."""
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, scale)
    first = rows.select("vec_id", "q").orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    start = [[int(np.floor(v)) for v in r["q"]] for r in first]
    books = [Codebook([q[at] for q in start]) for at in cut(len(start[0]), parts)]
    slices = _slices(rows, parts)
    for _ in range(rounds):
        books = _round(slices, books)
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b.entries for v in e).encode()).hexdigest()
    coded = _final(slices, books)
    labels = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    labels = stage(labels.select(F.col("label").alias("of_label"), F.least("total", F.lit(_LARGEST).cast("decimal(38,0)")).cast("long").alias("label_error")), "label-errors")
    labels = F.broadcast(labels) if labels.count() <= _BROADCAST_LABELS else labels
    return coded.join(labels, F.col("label").eqNullSafe(F.col("of_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    steps = [
        """kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS k, label, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
)""",
        "parts AS MATERIALIZED (SELECT k, p, q[p * (len(q) // 4) + 1 : (p + 1) * (len(q) // 4)] AS v FROM kept, range(4) t(p))",
        "book0 AS MATERIALIZED (SELECT p, k - 1 AS e, v AS c FROM parts WHERE k <= 256)",
    ]
    for n in range(ROUNDS + 1):
        steps.append(
            f"""near{n} AS MATERIALIZED (
  SELECT k, p, v, min(list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::HUGEINT * 256 + e) AS m
  FROM parts JOIN book{n} USING (p) GROUP BY k, p, v
)"""
        )
        if n < ROUNDS:
            steps.append(
                f"""book{n + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(mean, c) AS c FROM book{n} LEFT JOIN (
    SELECT p, e, list(avg ORDER BY i) AS mean FROM (
      SELECT p, e, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS avg
      FROM (SELECT p, (m % 256)::BIGINT AS e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near{n}) GROUP BY p, e, i
    ) GROUP BY p, e
  ) USING (p, e)
)"""
            )
    return f"""WITH {", ".join(steps)},
digest AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM book{ROUNDS})),
coded AS (SELECT k, string_agg(printf('%02x', (m % 256)::BIGINT), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error FROM near{ROUNDS} GROUP BY k)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (k), digest"""


@query("op11_vector_codes", _sql())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
