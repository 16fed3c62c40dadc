"""Literal cases and brute-force checks of the scalar functions."""

import math
import random
import zlib

import unicodedata

from pyspark.sql import functions as F

from tracelake.functions import geometry as geo
from tracelake.functions import scoring, udfs
from tracelake.functions import text as tx
from tracelake.operators.compare import token_f1
from tracelake.operators.reuse import common_prefix_length, shared_prefix
from tracelake.streaming.jobs import row_token_f1


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def lit(s):
    return F.lit(s)


def test_token_f1(spark):
    df = spark.createDataFrame([(1, "a b b", "b b c"), (2, "", ""), (3, "a", " "), (4, "A  b", "a b")], "id int, p string, r string")
    got = {r["id"]: (r["f1"], r["em"]) for r in token_f1(df, "id", "p", "r").collect()}
    assert math.isclose(got[1][0], 2 / 3) and got[2] == (1.0, 1.0) and got[3] == (0.0, 0.0) and got[4] == (1.0, 1.0)
    rows = df.select("id", row_token_f1(F.col("p"), F.col("r")).alias("f1")).collect()
    assert all(math.isclose(r["f1"], got[r["id"]][0]) for r in rows)


def test_penalty_points(spark):
    vals = [0.005, 0.010, 0.015, 0.0175, 0.020]
    df = spark.createDataFrame([(v,) for v in vals], "d double").select(scoring.accuracy_penalty(F.col("d")).alias("p"))
    assert all(math.isclose(r["p"], w, abs_tol=1e-9) for r, w in zip(df.collect(), [1, 0.75, 0.5, 0.25, 0]))


def test_trimmed_median(spark):
    cases = [
        ([], None), ([10.0], None), ([10.0, 20.0], 15.0), ([30.0, 10.0, 20.0], 20.0), ([1.0, 100.0, 2.0, 3.0], 2.5), ([5.0, 1.0, 9.0, 7.0, 100.0], 7.0),
        # 40 values lose two at each end, so 100 outliers below and above change nothing
        ([-1e9, -1e9, *map(float, range(36)), 1e9, 1e9], 17.5), ([float(k) for k in range(101)], 50.0),
    ]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, g array<double>")
    got = {r["i"]: r["m"] for r in df.select("i", scoring.trimmed_median(F.col("g")).alias("m")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_effective_edges(spark):
    e = lambda t, b, n: scoring.request_effective(F.lit(t).cast("double"), F.lit(b).cast("double"), F.lit(n), F.lit(1500.0), F.lit(45.0))
    r = one(spark, a=e(1500.0, 45.0, 1), b=e(1.0, 1.0, 0), c=e(1.0, None, 5))
    assert (r["a"], r["b"], r["c"]) == (True, False, False)


def test_ers_literal(spark):
    r = one(spark, s=scoring.ers_score(F.lit(None).cast("string"), F.lit(800.0), F.lit(32.5)))
    assert math.isclose(r["s"], 0.25)


def test_token_counts(spark):
    r = one(spark, a=tx.token_estimate(F.lit(2)), b=tx.token_estimate(F.lit(6)), c=tx.token_estimate(F.lit(10)), d=tx.prompt_tokens(F.lit("")))
    assert (r["a"], r["b"], r["c"], r["d"]) == (1, 2, 2, 0)


def test_hashes_equal_crc32(spark):
    texts = ["", "héllo 😀 world", "a b " * 900, " lead", "x" * 5000]
    df = spark.createDataFrame([(i, t, max(1, round(len(t) / 4))) for i, t in enumerate(texts)], "i int, t string, n int")
    rows = df.select("i", tx.word_block_hashes(F.col("t")).alias("w"), tx.char_block_hashes(F.col("t"), F.col("n")).alias("c")).collect()
    crc = lambda s: zlib.crc32(s.encode()) & 0xFFFFFF
    for r in rows:
        t, n = texts[r["i"]], max(1, round(len(texts[r["i"]]) / 4))
        w = t.split()
        assert r["w"] == ([crc(" ".join(w[k : k + 384])) for k in range(0, len(w), 384)] or [crc("")])
        blocks = max(1, -(-n // 512))
        parts = [t[k * 2048 : (k + 1) * 2048] for k in range(blocks)]
        assert r["c"] == [crc(p or f"__pad_{k}") for k, p in enumerate(parts)]


def test_natural_truncate(spark):
    # a budget of 5 tokens is 20 characters; a cut is taken only behind the 7th
    cases = [
        ("short enough", "short enough"), ("", ""), ("a" * 30, "a" * 20), ("aaaaaaaaaa. bbbbbbbbbbbbbbb", "aaaaaaaaaa."), ("aa. bbbbbbbbbbbbbbbbbbbbbbbbb", "aa. bbbbbbbbbbbbbbbb"),
        ("aaaaaaaaa\nbb. cc dddddddddddd", "aaaaaaaaa"), ("aaaaaaaaaa\n\nbbb\ncccccccccccc", "aaaaaaaaaa"), ("aaaaaaaa? bbbb! cccccccccccccc", "aaaaaaaa?"), ("aaaaaaaaaaaaaaaaaaa bbbbbbbbbbb", "aaaaaaaaaaaaaaaaaaa"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", tx.natural_truncate(F.col("t"), F.lit(5)).alias("c")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(["ab", " ", ". ", "\n", "? ", "xyz"]) for _ in range(80)) for _ in range(60)]
    df = spark.createDataFrame([(t, 10 + i % 20) for i, t in enumerate(texts)], "t string, m int")
    for r in df.select("t", "m", tx.natural_truncate(F.col("t"), F.col("m")).alias("c")).collect():
        assert r["t"].startswith(r["c"]) and len(r["c"]) <= 4 * r["m"]


def test_common_prefix(spark):
    df = spark.createDataFrame([("g", "abcx"), ("g", "abd"), ("g", "abzz"), ("e", "😀a"), ("e", "😀b"), ("s", "same"), ("s", "same"), ("n", ""), ("n", "q")], "k string, t string")
    got = {r["k"]: r["prefix_chars"] for r in shared_prefix(df, ["k"], "t").collect()}
    assert got == {"g": 2, "e": 1, "s": 4, "n": 0}
    assert one(spark, p=common_prefix_length(lit("ab"), lit("abc")))["p"] == 2


def test_fold(spark):
    names = ["Giấy Gửi Tiền", "ĐẾN Ngày", "Tài khoản ghi nợ", "Ưu đãi ơ", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    rows = df.select(udfs.fold_text("n").alias("a"), tx.fold_latin(F.col("n")).alias("b")).collect()
    assert [r["a"] for r in rows] == ["giayguitien", "denngay", "taikhoanghino", "uudaio", None]
    assert [r["b"] for r in rows] == [r["a"] for r in rows]


def test_first_json():
    assert udfs.find_json('x {bad} ```json\n{"a": {"b": 1}}\n``` {"z":1}') == '{"a": {"b": 1}}'
    assert udfs.find_json('note {not json} then {"k": [1]} end') == '{"k": [1]}'
    assert udfs.find_json("none") is None and udfs.find_json(None) is None


def test_boxes(spark):
    a, b = geo.box(*map(F.lit, (0, 0, 2, 2))), geo.box(*map(F.lit, (1, 1, 3, 3)))
    r = one(spark, i=geo.iou(a, b), p=geo.parse_box(lit("10 20 300 400")), bad=geo.parse_box(lit("1 2 x 4")), short=geo.parse_box(lit("1 2 3")))
    assert math.isclose(r["i"], 1 / 7)
    assert tuple(r["p"]) == (10.0, 20.0, 300.0, 400.0) and r["bad"] is None and r["short"] is None


def test_bad_output_flags(spark):
    cases = {"": ["empty", "too_short"], "ok then": [], "a b " * 9: ["repeated_tail"], "x�y z": ["replacement_char"]}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    for r in df.select("t", tx.bad_output_flags(F.col("t")).alias("f")).collect():
        assert r["f"] == cases[r["t"]]


def test_prompt_from_chat(spark):
    cases = {
        '{"messages":[{"content":"a"},{"content":[{"type":"text","text":"b"},{"type":"image","text":"no"}]}]}': "a\nb",
        '{"messages":[],"prompt":"p"}': "p",
        '{"prompt":["x","y"]}': "x\ny",
        "{}": "",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    for r in df.select("t", tx.prompt_from_chat(F.col("t")).alias("p")).collect():
        assert r["p"] == cases[r["t"]], r["t"]


def test_output_cleaning(spark):
    r = one(
        spark, a=tx.cut_markers(lit("text <THINK>no")), b=tx.cut_markers(lit("<think>kept as start")), c=tx.cut_decoded(lit("x</html>y")),
        d=tx.from_first_div(lit("```html\npre <DIV>z</DIV>\n```")),
    )
    assert (r["a"], r["b"], r["c"], r["d"]) == ("text", "<think>kept as start", "x", "<DIV>z</DIV>")


def test_fold_over_the_whole_code_table(spark):
    def plain(text):
        base = unicodedata.normalize("NFKD", text.translate(str.maketrans("đĐơƠưƯ", "dDoOuU")).lower())
        return "".join(c for c in base if "a" <= c <= "z" or c.isdigit())

    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(map(chr, codes[k : k + 97])) for k in range(0, len(codes), 97)]
    texts += ["ﬁn ① ⒓ ㎏ 𝐀𝟗 ٣² ½", "e\u0301\u0323", "Ａｂ９", ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").repartition(8)
    got = {r["k"]: r["f"] for r in df.select("k", tx.fold_latin(F.col("t")).alias("f")).collect()}
    wrong = [(k, t) for k, t in enumerate(texts) if got[k] != plain(t)]
    assert not wrong, [c for c in wrong[0][1] if plain(c) not in got[wrong[0][0]]][:9]
    assert [udfs.fold(t) for t in texts] == [plain(t) for t in texts]


def test_folding_asks_large_classes_of_rare_characters_only(spark):
    """4 million letters in a row, some accented: every one was compared with hundreds of ranges before."""
    import time

    df = spark.createDataFrame([("a",), ("b",)], "t string").select(F.md5(tx.fold_latin(F.concat(F.lit("é–"), F.repeat("t", 4_000_000)))).alias("f"))
    df.collect()
    t0 = time.time()
    df.collect()
    assert time.time() - t0 < 8
