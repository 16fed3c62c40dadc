import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tracelake.llm import token_shards as ts

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(rows):
    """Brute force: encode each text whole, in ascending doc_id order."""
    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def shards(spark, rows, tmp_path, n=4):
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, path string, start int")
    return ts.write(docs, f"file://{tmp_path}/out", PATH, n)


def result(manifest):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in ts.read(manifest).collect()), key=lambda r: r[1])


def test_matches_whole_text_encoding(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert result(shards(spark, rows, tmp_path)) == whole(rows)


def test_odd_texts(spark, tmp_path):
    rows = [
        (5, None), (3, ""), (4, " \t\n"), (9, "one"), (9, "one"), (9, "two"), (None, "no key"), (1, "CAFÉ é ́x ΣΑΣ İ a b c　d\u0085e \x1cf\x1f"),
        (2, "<|endoftext|>x<|startoftext|> don't I'LL 12a3 ½ 🙂👩‍👩‍👧"), (12, "A <|endoftext|> b <|ENDOFTEXT|> É× ÷. É. Été, . ,, x., <|EndOfText|>."), (13, "é" * 9 + ". ŉ İx, ẞß. <|endoftext|"), (7, "z" * 60000), (8, "ab cd " * 40000), (-6, "neg ​﻿ ﬁ"),
    ]
    assert result(shards(spark, rows, tmp_path)) == whole(rows)


def test_an_empty_table_and_more_shards_than_rows(spark, tmp_path):
    assert result(shards(spark, [], tmp_path)) == []
    assert result(shards(spark, [(2, "b"), (1, "a")], tmp_path / "few", 9)) == whole([(1, "a"), (2, "b")])


def test_fetch_by_key(spark, tmp_path):
    rows = [(k * 7, f"text {k}") for k in range(300)] + [(14, "text 2 again")]
    manifest = shards(spark, rows, tmp_path)
    keys = spark.createDataFrame([(0,), (14,), (693,), (5,), (10**12,), (-3,), (None,)], "doc_id long")
    got = sorted((r.doc_id, r.ids) for r in ts.fetch(keys, manifest).collect())
    t = Tokenizer.from_file(PATH)
    want = sorted((d, [*t.encode(x, add_special_tokens=False).ids, 1]) for d, x in rows if d in (0, 14, 693))
    assert got == want


def test_the_index_is_minimal_and_tells_strange_keys():
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 20000)
    index = ts.KeyIndex.build(keys)
    assert sorted(index.slots(keys)) == list(range(len(keys)))
    assert ts.KeyIndex.build(np.zeros(0, np.int64)).slots(keys[:5]).tolist() == [-1] * 5
