"""Token ids as raw binary shards with a minimal perfect hash index from document key to place.

``write`` sorts documents by doc_id into ranges, one shard each, and encodes whole texts in the tasks. A shard is
two files: ``.ids`` holds the ids and nothing else (little-endian, two bytes each while the vocabulary fits), every
document followed by the end id; ``.idx`` holds the index. Its hash is built in levels: the keys that fall alone on
a bit of a level's bit array set it, the others go on to the next level, and the number of set bits before a key's
bit is its slot. A slot holds a fingerprint of the key (a key that is not in the shard is told by it) and its first
row; a row holds doc_id and offset. A lookup costs a few bit tests, whatever the size.

Files are written under a name of their own and renamed when whole, so a task that runs again, or twice, leaves
one whole file. They belong in a folder that all machines share; any store that Arrow can open will do.

Encoding is that of the whole text, special strings included: ASCII white space always separates tokens of this vocabulary, so
ids are kept per distinct word, as one array of a worker (of about ``CACHE`` words, then it starts anew), and only new words go
to the tokenizer, in batches; a text's ids are gathered from the array.

Defined cases: a null or empty text is the end id alone; rows with the same doc_id follow one another and share a
key; a null doc_id comes first and has no key; an empty table gives no shard; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracelake.llm.catalog import documents, query
from tracelake.llm.wordbytes import LOWER, Words, mix, slices
from tracelake.session import scratch_dir, stage

END_ID = 1
CACHE = 1_000_000
_END_PLACE, _NO_PLACE = 2, -1
#: Bytes outside A-Z, a-z and the two-byte Latin letters; a mark or another script has one of them.
_NO_LETTER = np.ones(256, bool)
_NO_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = False
_SPACING = 2
_MANIFEST = "shard int, path string, n_docs long, n_ids long, least long, most long"


class Encoder:
    """Ids of whole texts, by distinct words.

    A word of Latin letters, perhaps with a full stop or comma behind, is told by its stem with A-Z in lower case, another word by
    all its bytes, A-Z in lower case too (the tokenizer lowers every letter), and a word that holds a special string, or would in lower
    case, as it stands.
    """

    def __init__(self, tokenizer_path: str):
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if len(vocabulary) <= 1 << 16 else "<u4")
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a run of letters
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(re.escape(x.lower()) for x in specials)) if specials else None
        self.clear()

    def clear(self) -> None:
        """Only the marks and the end id, at the first places."""
        marks = [*self._ids([".", ","]), np.array([END_ID], self.kind)]
        self.pool = np.concatenate(marks)
        self.ends = np.cumsum([0, *map(len, marks)])
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, stems: list[str]) -> list[list[int] | np.ndarray]:
        """Ids of words of Latin letters: ASCII ones are one pre-token as they stand, so they go to the tokenizer's model at
        once; the others are encoded in one text, where each ends with the only id that ends a run."""
        tokenize = self.tokenizer.model.tokenize
        ids = {w: [t.id for t in tokenize(w)] for w in stems if w.isascii()}
        rest = [w for w in stems if w not in ids]
        if rest:
            (codes,) = self._ids([" ".join(rest)])
            ends = np.flatnonzero(self.last[codes]) + 1
            ids.update(zip(rest, np.split(codes, ends[:-1]) if len(ends) == len(rest) else self._ids(rest), strict=True))
        return [ids[w] for w in stems]

    def _learn(self, hashes: np.ndarray, words: list[str], letters: np.ndarray) -> None:
        """Append the ids of new words to the pool."""
        found: list = [None] * len(words)
        for own, look in ((np.flatnonzero(letters), self._letters), (np.flatnonzero(~letters), self._ids)):
            for lo in range(0, len(own), 5000):
                some = own[lo : lo + 5000].tolist()
                for k, ids in zip(some, look([words[k] for k in some]), strict=True):
                    found[k] = ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((i for f in found for i in f), self.kind, int(sizes.sum()))
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.place = np.insert(self.place, at, len(self.ends) - 1 + np.arange(len(words)))
        self.pool = np.concatenate([self.pool, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, the end id after each, and the number of each text's ids."""
        lowered = LOWER[data]
        words = Words(lowered, offsets)
        start, end = words.start, words.end.copy()
        last, alone = lowered[end - 1], end - start == 1
        mark = np.where(alone, -1, np.where(last == 0x2E, 0, np.where(last == 0x2C, 1, -1)))
        foreign = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_NO_LETTER[lowered], out=foreign[1:])
        for sign in (0x97, 0xB7):  # the two signs among the Latin letters
            foreign[1:] += np.cumsum((lowered == 0xC3) & (np.append(lowered[1:], 0) == sign))
        stem_end = end - (mark >= 0)
        letters = foreign[stem_end] == foreign[start]
        mark[~letters] = -1
        end = np.where(letters, stem_end, end)
        words.end = end
        hashes, texts = words.hashes(), lowered
        if self.special and (hits := [m.start() for m in self.special.finditer(lowered.tobytes())]):
            raw = np.unique(np.searchsorted(start, hits, side="right") - 1)
            whole = Words(data, offsets)
            hashes[raw] = mix(whole.hashes()[raw] ^ np.uint64(0x2545F4914F6CDD1D))
            letters[raw], mark[raw], end[raw] = False, -1, whole.end[raw]
            texts = lowered.copy()
            for k in raw.tolist():
                texts[start[k] : end[k]] = data[start[k] : end[k]]
        distinct, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > CACHE:
            self.clear()
        at = np.searchsorted(self.known, distinct)
        new = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(new):
            raw = texts.tobytes()
            spans = zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)
            self._learn(distinct[new], [raw[a:b].decode() for a, b in spans], letters[first[new]])
        place = self.place[np.searchsorted(self.known, distinct)][number]
        # of each word its own ids and those of its mark; after each text the end id
        n_words = np.diff(words.row_start)
        unit_end = np.cumsum(2 * n_words + 1)
        units = np.full(int(unit_end[-1]) if len(unit_end) else 0, _END_PLACE)
        at = 2 * np.arange(len(words)) + words.row
        units[at] = place
        units[at + 1] = np.where(mark < 0, _NO_PLACE, mark)
        low, size = self.ends[units], np.where(units == _NO_PLACE, 0, self.ends[np.minimum(units + 1, len(self.ends) - 1)] - self.ends[units])
        stop = np.cumsum(size)
        codes = self.pool[np.repeat(low - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)]
        return codes, np.diff(np.concatenate([[0], stop[unit_end - 1]]))


_encoders: dict[str, Encoder] = {}


def encoder(tokenizer_path: str) -> Encoder:
    if tokenizer_path not in _encoders:
        _encoders[tokenizer_path] = Encoder(tokenizer_path)
    return _encoders[tokenizer_path]


def _store(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in folder:
        return pyarrow.fs.FileSystem.from_uri(folder)
    return pyarrow.fs.LocalFileSystem(), folder.removeprefix("file:")


class KeyIndex:
    """Minimal perfect hash over distinct keys, by levels of bit arrays."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # bits of each level, as bytes of 0 and 1
        ones = [int(x.sum()) for x in levels]
        self.before = np.cumsum([0, *ones])
        self.ranks = [np.cumsum(x, dtype=np.int64) - x for x in levels]

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))
        return (mix(keys.view(np.uint64) + salt) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> KeyIndex:
        levels = []
        while len(keys):
            size = max(_SPACING * len(keys), 8)
            at = cls._places(keys, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone.astype(np.uint8))
            keys = keys[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level has its bit. A strange key may get a slot: compare fingerprints."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = self._places(keys[open_], level, len(bits))
            hit = bits[at] == 1
            out[open_[hit]] = self.before[level] + self.ranks[level][at[hit]]
            open_ = open_[~hit]
        return out


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def _dump(arrays: dict[str, np.ndarray]) -> bytes:
    head = json.dumps([(k, str(v.dtype), len(v)) for k, v in arrays.items()]).encode() + b"\n"
    return head + b"".join(v.tobytes() for v in arrays.values())


def _load(data: bytes) -> dict[str, np.ndarray]:
    head, _, _ = data.partition(b"\n")
    out, at = {}, len(head) + 1
    for name, kind, n in json.loads(head):
        out[name] = np.frombuffer(data, kind, n, at)
        at += out[name].nbytes
    return out


class Shard:
    """A written shard: rows in order, and lookups by key."""

    def __init__(self, path: str):
        store, self.path = _store(path)
        with store.open_input_stream(f"{self.path}.idx") as f:
            index = _load(f.readall())
        self.store, self.kind = store, np.dtype(str(index["kind"].tobytes().decode()))
        self.ids, self.known, self.offsets = index["ids"], index["known"], index["offsets"]
        self.fingerprints, self.first = index["fingerprints"], index["first"]
        bounds = np.cumsum([0, *index["levels"]])
        bits = np.unpackbits(index["bits"])[: bounds[-1]]
        self.index = KeyIndex([bits[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """First row of each key, -1 for a key that the shard does not hold."""
        slot = self.index.slots(keys)
        row = np.full(len(keys), -1, np.int64)
        have = np.flatnonzero(slot >= 0)
        same = self.fingerprints[slot[have]] == _fingerprint(keys[have])
        row[have[same]] = self.first[slot[have[same]]]
        return row

    def payload(self) -> np.ndarray:
        with self.store.open_input_stream(f"{self.path}.ids") as f:
            return np.frombuffer(f.readall(), self.kind)

    def read(self, file, row: int) -> np.ndarray:
        """Ids of one row, read from its place in an open ``.ids`` file."""
        file.seek(int(self.offsets[row]) * self.kind.itemsize)
        return np.frombuffer(file.read(int(self.offsets[row + 1] - self.offsets[row]) * self.kind.itemsize), self.kind)


def _index(ids: np.ndarray, known: np.ndarray, offsets: np.ndarray, kind: np.dtype) -> bytes:
    rows = np.flatnonzero(known)
    keys, first = np.unique(ids[rows], return_index=True)
    index = KeyIndex.build(keys)
    slot = index.slots(keys)
    fingerprints, place = np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.int64)
    fingerprints[slot], place[slot] = _fingerprint(keys), rows[first]
    return _dump({
        "kind": np.frombuffer(kind.str.encode(), np.uint8), "ids": ids, "known": known, "offsets": offsets, "fingerprints": fingerprints,
        "first": place, "levels": np.array([len(x) for x in index.levels], np.int64),
        "bits": np.packbits(np.concatenate([np.zeros(0, np.uint8), *index.levels])),
    })


def write(docs: DataFrame, folder: str, tokenizer_path: str, shards: int | None = None) -> DataFrame:
    """Write the shards under ``folder``; returns the manifest: shard, path, n_docs, n_ids, least and most doc_id."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, coder = TaskContext.get().partitionId(), encoder(tokenizer_path)
        store, root = _store(folder)
        path, own = f"{root}/shard-{number:06d}", f"{root}/.{uuid.uuid4().hex}"
        ids, sizes = [pa.array([], pa.int64())], [np.zeros(1, np.int64)]
        file = None
        for batch in batches:
            if file is None:
                store.create_dir(root, recursive=True)
                file = store.open_output_stream(f"{own}.ids")
            for _, _, data, offsets in slices(batch.column("text")):
                codes, n = coder.encode(data, offsets)
                sizes.append(n)
                file.write(codes.tobytes())
            ids.append(batch.column("doc_id"))
        if file is None:
            return
        file.close()
        keys = pa.concat_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in ids])
        known = keys.is_valid().to_numpy(zero_copy_only=False)
        values = keys.fill_null(0).to_numpy()
        offsets = np.cumsum(np.concatenate(sizes))
        with store.open_output_stream(f"{own}.idx") as f:
            f.write(_index(values, known, offsets, coder.kind))
        for end in ("ids", "idx"):
            store.move(f"{own}.{end}", f"{path}.{end}")
        real = values[known]
        yield pa.record_batch(
            [
                pa.array([number], pa.int32()), pa.array([f"{folder}/shard-{number:06d}"]), pa.array([len(values)], pa.int64()),
                pa.array([int(offsets[-1])], pa.int64()), pa.array([int(real[0]) if len(real) else None], pa.int64()),
                pa.array([int(real[-1]) if len(real) else None], pa.int64()),
            ],
            ["shard", "path", "n_docs", "n_ids", "least", "most"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return stage(dealt.mapInArrow(run, _MANIFEST), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files through their index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                shard = Shard(path)
                payload = shard.payload()
                row = np.arange(len(shard.ids))
                keyed = np.flatnonzero(shard.known)
                keys = shard.ids[keyed]
                # rows of one key follow its first row
                row[keyed] = shard.find(keys) + np.arange(len(keys)) - np.searchsorted(keys, keys)
                start, end = shard.offsets[row], shard.offsets[row + 1]
                crc = [zlib.crc32(payload[a:b].astype("<u4").tobytes()) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                yield pa.record_batch(
                    [pa.array(shard.ids, mask=~shard.known), pa.array(start + base), pa.array(end - start), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    total = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.select("shard", "path", F.coalesce(total, F.lit(0)).alias("base"))
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(tasks, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(keys: DataFrame, manifest: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents with the given keys; a key that no shard holds gives no row.

    The manifest has one row per shard and goes to the tasks; of the shards, only the wanted places are read.
    """
    shards = [tuple(r) for r in manifest.where("least IS NOT NULL").select("least", "most", "path").orderBy("shard").collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = np.unique(batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
            for least, most, path in shards:
                own = wanted[np.searchsorted(wanted, least) : np.searchsorted(wanted, most, side="right")]
                if not len(own):
                    continue
                shard = Shard(path)
                rows = shard.find(own)
                found, out = [], []
                with shard.store.open_input_file(f"{shard.path}.ids") as file:
                    for key, row in zip(own[rows >= 0].tolist(), rows[rows >= 0].tolist(), strict=True):
                        while row < len(shard.ids) and shard.ids[row] == key and shard.known[row]:
                            found.append(key)
                            out.append(shard.read(file, row).astype(np.int64))
                            row += 1
                yield pa.record_batch([pa.array(found, pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return keys.select(F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, ids array<long>")


def encode_documents(docs: DataFrame, folder: str | None = None, tokenizer_path: str | None = None, shards: int | None = None) -> DataFrame:
    """Write the shards (in a new folder of the shared one, unless named) and read them back."""
    folder = folder or scratch_dir(docs.sparkSession, "token-ids")
    return read(write(docs, folder, tokenizer_path or public_tokenizers.path("word_bpe_49k.json"), shards))


@query("op6_token_shards")
def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir))
