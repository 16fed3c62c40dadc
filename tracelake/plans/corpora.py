"""Registered queries: text functions and prompt-reuse analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import text as tx
from tracelake.operators import reuse
from tracelake.plans.catalog import query, rounded
from tracelake.plans.fixtures import QA, chats, qa, spread, table

# DuckDB counterparts
WS = r"[\s\p{Z}\x{0085}\x{000B}]"


def sql_norm(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '{WS}+', ' ', 'g'))"


def sql_words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{WS}+'), lambda w: w <> '')"


def docs(spark, sf):
    return spread(table(spark, sf, "documents"))


def _first_word():
    return F.substring_index("text", " ", 1).alias("word")


GROUPED = "grp AS (SELECT *, split_part(text, ' ', 1) AS word FROM documents)"

CONTEXT = QA + """, ctx AS (
  SELECT c.role AS config, qa.conv_id AS doc_id, qa.turn AS pos, qa.question, qa.answer,
    CASE WHEN length(qa.question) > 250 THEN c.text || ' +' ELSE c.text END AS context
  FROM qa JOIN conversations c ON c.conv_id = qa.conv_id AND c.turn = 0)"""


def contexts(spark, sf):
    """Questions with the context of their document (first turn of the conversation)."""
    first = table(spark, sf, "conversations").filter("turn = 0").select(
        "conv_id", F.col("role").alias("config"), F.col("text").alias("c0")
    )
    return qa(spark, sf).join(first, "conv_id").select(
        "config", F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "question", "answer",
        F.when(F.length("question") > 250, F.concat("c0", F.lit(" +"))).otherwise(F.col("c0")).alias("context"),
    )


@query(
    "f01_char_stats",
    f"""WITH w AS (SELECT doc_id, length(text) AS chars, len({sql_words('text')}) AS words FROM documents)
    SELECT doc_id, chars, words, round(chars / CAST(greatest(words, 1) AS DOUBLE), 6) AS chars_per_word FROM w""",
)
def f01(spark, sf):
    return rounded(reuse.character_statistics(docs(spark, sf), ["doc_id"], "text"), "chars_per_word")


@query(
    "f02_token_estimates",
    """SELECT doc_id, CAST(greatest(1, round_even(length(text) / 4.0, 0)) AS BIGINT) AS tokens, CAST(greatest(1, length(text) * 4) AS BIGINT) AS chars_back,
    CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 3) END AS prompt_tokens FROM documents""",
)
def f02(spark, sf):
    n = F.length("text")
    return docs(spark, sf).select(
        "doc_id", tx.token_estimate(n).alias("tokens"), tx.chars_for_tokens(n).alias("chars_back"),
        tx.prompt_tokens(F.col("text")).alias("prompt_tokens"),
    )


@query("f03_normalize_text", f"SELECT doc_id, md5({sql_norm('text')}) AS digest FROM documents")
def f03(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(tx.normalize_text(F.col("text"))).alias("digest"))


@query(
    "f04_match_and_token_f1",
    f"""WITH {QA}, t AS (SELECT qa_id, 1 AS p, 0 AS r, unnest({sql_words(sql_norm('answer'))}) AS tok FROM qa
      UNION ALL SELECT qa_id, 0, 1, unnest({sql_words(sql_norm('question'))}) FROM qa),
    c AS (SELECT qa_id, tok, sum(p) AS p, sum(r) AS r FROM t GROUP BY 1, 2),
    s AS (SELECT qa_id, sum(least(p, r)) AS hits, sum(p) AS np, sum(r) AS nr FROM c GROUP BY 1)
    SELECT qa.qa_id, CASE WHEN coalesce(np, 0) = 0 AND coalesce(nr, 0) = 0 THEN 1.0 WHEN coalesce(hits, 0) = 0 THEN 0.0
      ELSE round(2.0::DOUBLE * hits / (np + nr), 6) END AS f1,
      CAST(CASE WHEN {sql_norm('answer')} = {sql_norm('question')} THEN 1 ELSE 0 END AS DOUBLE) AS em
    FROM qa LEFT JOIN s ON s.qa_id = qa.qa_id""",
)
def f04(spark, sf):
    from tracelake.operators.compare import token_f1

    return rounded(token_f1(qa(spark, sf), "qa_id", "answer", "question"), "f1")


@query("f10_hash_block")
def f10(spark, sf):
    return docs(spark, sf).select("doc_id", tx.hash_block(F.col("text")).alias("hash"))


@query("f11_hash_ids")
def f11(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select(
        "doc_id", F.array_join(tx.word_block_hashes(t).cast("array<string>"), " ").alias("word_blocks"),
        F.array_join(tx.char_block_hashes(t, tx.token_estimate(F.length("text"))).cast("array<string>"), " ").alias("char_blocks"),
    )


@query("f12_list_or_string", "SELECT doc_id, md5(text) AS digest FROM documents")
def f12(spark, sf):
    kind = F.col("doc_id") % 3
    quoted = F.expr("substr(to_json(array(text)), 2, length(to_json(array(text))) - 2)")
    d = docs(spark, sf).select(
        "doc_id",
        F.when(kind == 0, F.to_json(F.split("text", "\n"))).when(kind == 1, F.to_json(F.array("text"))).otherwise(quoted).alias("j"),
    )
    return d.select("doc_id", F.md5(tx.list_or_string(F.parse_json("j"))).alias("digest"))


def _trunc_sql(budget: str) -> str:
    def pos(sep):  # 0-based last position of sep in cut, -1 when absent
        return f"(CASE WHEN contains(cut, {sep}) THEN length(cut) - instr(reverse(cut), reverse({sep})) + 1 - length({sep}) ELSE -1 END)"

    seps = [("chr(10) || chr(10)", 0), ("chr(10)", 0), ("'. '", 1), ("'? '", 1), ("'! '", 1)]
    cases = " ".join(f"WHEN {pos('(' + s + ')')} > b // 3 THEN left(cut, {pos('(' + s + ')')} + {k})" for s, k in seps)
    return f"""WITH t AS (SELECT doc_id, text, {budget} AS mt FROM documents), u AS (SELECT *, CAST(mt * 4 AS BIGINT) AS b, left(text, mt * 4) AS cut FROM t)
    SELECT doc_id, md5(CASE WHEN greatest(1, round_even(length(text) / 4.0, 0)) <= mt THEN text
      ELSE regexp_replace(CASE {cases} ELSE cut END, '{WS}+$', '') END) AS digest FROM u"""


@query("f13_natural_truncate", _trunc_sql("CAST(50 + doc_id % 200 AS BIGINT)"))
def f13(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(tx.natural_truncate(F.col("text"), 50 + F.col("doc_id") % 200)).alias("digest"))


@query("f24_prompt_from_chat", "SELECT doc_id, md5(text) AS digest FROM documents")
def f24(spark, sf):
    return chats(spark, sf).select("doc_id", F.md5(tx.prompt_from_chat(F.col("payload"))).alias("digest"))


@query("f25_prefix_hash", "SELECT doc_id, CASE WHEN text = '' THEN '' ELSE left(sha256(text), 16) END AS prefix FROM documents")
def f25(spark, sf):
    return docs(spark, sf).select("doc_id", tx.prefix_hash(F.col("text")).alias("prefix"))


def _dist_sql(src: str, key: str, v: str) -> str:
    return f"""r AS (SELECT {key}, {v} AS v, row_number() OVER (PARTITION BY {key} ORDER BY {v}) - 1 AS rn, count(*) OVER (PARTITION BY {key}) AS n FROM {src}),
    dist AS (SELECT {key}, max(n) AS n, avg(v) AS chars_mean, max(CASE WHEN rn = n // 2 THEN v END) AS chars_p50,
      max(CASE WHEN rn = least(n * 90 // 100, n - 1) THEN v END) AS chars_p90, max(CASE WHEN rn = least(n * 99 // 100, n - 1) THEN v END) AS chars_p99,
      max(v) AS chars_max FROM r GROUP BY 1)"""


@query(
    "a09_length_distribution",
    f"""WITH {_dist_sql('documents', 'source', 'length(text)')} SELECT source, n, round(chars_mean, 6) AS chars_mean, CAST(chars_p50 AS DOUBLE) AS chars_p50,
    CAST(chars_p90 AS DOUBLE) AS chars_p90, CAST(chars_p99 AS DOUBLE) AS chars_p99, CAST(chars_max AS DOUBLE) AS chars_max,
    round(chars_mean / 4, 6) AS tokens_mean, round(chars_p99 / 4.0::DOUBLE, 6) AS tokens_p99 FROM dist""",
)
def a09(spark, sf):
    return rounded(reuse.length_distribution(docs(spark, sf), ["source"], F.length("text")), "chars_mean", "tokens_mean", "tokens_p99")


@query(
    "a10_text_statistics",
    """SELECT source, count(*) AS num_rows, round(avg(length(text)), 6) AS avg_chars, string_agg(DISTINCT lang, ',' ORDER BY lang) AS kinds,
    count(DISTINCT nullif(CAST(doc_id AS VARCHAR), '')) AS unique_docs FROM documents GROUP BY 1""",
)
def a10(spark, sf):
    return rounded(reuse.text_statistics(docs(spark, sf), ["source"], "text", "lang", "doc_id"), "avg_chars")


@query(
    "a11_class_rollup",
    "SELECT lang, source, count(*) AS num_rows, CAST(grouping_id(lang, source) AS BIGINT) AS level FROM documents GROUP BY ROLLUP (lang, source)",
)
def a11(spark, sf):
    return reuse.class_rollup(docs(spark, sf), "lang", "source")


_COPIES = """copies AS (SELECT source, count(*) AS unique_exact, CAST(sum(c) AS BIGINT) AS rows, CAST(sum(CASE WHEN c > 1 THEN c - 1 ELSE 0 END) AS BIGINT) AS extra_rows,
   count(*) FILTER (WHERE c > 1) AS groups_2plus FROM (SELECT source, sha256(text) AS h, count(*) AS c FROM documents GROUP BY 1, 2) GROUP BY 1)"""


@query("a12_exact_copies", f"WITH {_COPIES} SELECT * FROM copies")
def a12(spark, sf):
    return reuse.exact_copies(docs(spark, sf), ["source"], "text")


_DOCG = CONTEXT + """, dg AS (SELECT config, doc_id, count(*) AS q, CAST(sum(length(context)) AS BIGINT) AS naive, min(length(context)) = max(length(context)) AS uniform,
   min_by(length(context), pos) AS first_chars FROM ctx GROUP BY 1, 2)"""


@query(
    "a13_document_reuse",
    f"""WITH {_DOCG}, o AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY q) - 1 AS rn, count(*) OVER (PARTITION BY config) AS n FROM dg)
    SELECT config, count(*) AS documents, CAST(sum(q) AS BIGINT) AS rows, round(avg(q), 6) AS questions_mean, max(q) AS questions_max,
    count(*) FILTER (WHERE uniform) AS uniform_documents, CAST(max(CASE WHEN rn = n // 2 THEN q END) AS DOUBLE) AS questions_p50,
    CAST(max(CASE WHEN rn = least(n * 90 // 100, n - 1) THEN q END) AS DOUBLE) AS questions_p90, CAST(max(CASE WHEN rn = least(n * 99 // 100, n - 1) THEN q END) AS DOUBLE) AS questions_p99
    FROM o GROUP BY 1""",
)
def a13(spark, sf):
    return rounded(reuse.document_reuse(contexts(spark, sf), ["config"], "doc_id", "context", "pos"), "questions_mean")


@query(
    "a14_prefill_savings",
    f"""WITH {_DOCG} SELECT config, CAST(sum(naive) AS BIGINT) AS naive_chars, CAST(sum(first_chars) AS BIGINT) AS unique_chars, CAST(sum(q) AS BIGINT) AS rows, count(*) AS documents,
    round(1 - sum(first_chars) / CAST(greatest(sum(naive), 1) AS DOUBLE), 6) AS savings, round(sum(q) / CAST(greatest(count(*), 1) AS DOUBLE), 6) AS queries_per_prefill
    FROM dg GROUP BY 1""",
)
def a14(spark, sf):
    return rounded(reuse.prefill_savings(contexts(spark, sf), ["config"], "doc_id", "context", "pos"), "savings", "queries_per_prefill")


_LCP = GROUPED + """, ends AS (SELECT source, word, min(text) AS lo, max(text) AS hi, count(*) AS n, max(length(text)) AS max_chars, CAST(sum(length(text)) AS BIGINT) AS sum_chars,
    CAST(sum(length(lang)) AS BIGINT) AS inst_chars FROM grp GROUP BY 1, 2),
  ch AS (SELECT source, word, unnest(range(1, least(length(lo), length(hi)) + 1)) AS i, unnest(string_split(left(lo, least(length(lo), length(hi))), '')) AS a,
    unnest(string_split(left(hi, least(length(lo), length(hi))), '')) AS b FROM ends WHERE lo <> hi),
  mm AS (SELECT source, word, min(i) AS i FROM ch WHERE a <> b GROUP BY 1, 2),
  lcp AS (SELECT e.*, CASE WHEN lo = hi THEN length(lo) WHEN mm.i IS NOT NULL THEN mm.i - 1 ELSE least(length(lo), length(hi)) END AS prefix_chars
    FROM ends e LEFT JOIN mm ON mm.source = e.source AND mm.word = e.word)"""


@query("a15_shared_prefix", f"WITH {_LCP} SELECT source, word, n, prefix_chars, max_chars, sum_chars FROM lcp")
def a15(spark, sf):
    return reuse.shared_prefix(docs(spark, sf).select("source", _first_word(), "text"), ["source", "word"], "text")


_REUSE = _LCP + """, ru AS (SELECT *, prefix_chars > 0 AND max_chars = prefix_chars AS fullp, sum_chars + inst_chars AS naive_chars,
   sum_chars - n * prefix_chars AS suffix FROM lcp),
   rv AS (SELECT *, CASE WHEN fullp THEN prefix_chars + inst_chars WHEN prefix_chars > 500 THEN prefix_chars + suffix + inst_chars ELSE naive_chars END AS optimized_chars FROM ru),
   rep AS (SELECT source, word, n, prefix_chars, round(suffix / CAST(n AS DOUBLE), 6) AS suffix_mean,
   CASE WHEN fullp THEN 'HIGH_REUSE' WHEN prefix_chars > 100 THEN 'PARTIAL_REUSE' ELSE 'LOW_REUSE' END AS reuse, naive_chars, optimized_chars,
   round(CASE WHEN fullp OR prefix_chars > 500 THEN 1 - optimized_chars / CAST(greatest(naive_chars, 1) AS DOUBLE) ELSE 0 END, 6) AS savings FROM rv)"""


@query("a16_prefix_reuse", f"WITH {_REUSE} SELECT * FROM rep")
def a16(spark, sf):
    d = docs(spark, sf).select("source", _first_word(), "text", "lang")
    return rounded(reuse.prefix_reuse(d, ["source", "word"], "text", "lang"), "suffix_mean", "savings")


@query("a17_mean_length_ratio", f"WITH {CONTEXT} SELECT config, round(avg(length(answer)) / greatest(avg(length(context)), 1), 6) AS ratio FROM ctx GROUP BY 1")
def a17(spark, sf):
    return rounded(reuse.mean_length_ratio(contexts(spark, sf), ["config"], "answer", "context"), "ratio")


@query(
    "a21_session_statistics",
    f"WITH {GROUPED} SELECT source, count(*) AS sessions, count(*) FILTER (WHERE c >= 2) AS sessions_2plus FROM (SELECT source, word, count(*) AS c FROM grp GROUP BY 1, 2) GROUP BY 1",
)
def a21(spark, sf):
    return reuse.session_statistics(docs(spark, sf).select("source", _first_word()), "word", ["source"])


@query(
    "a22_prefix_verified",
    """WITH grp AS (SELECT *, left(text, 60) AS word FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY source, word ORDER BY doc_id) AS rn FROM grp),
    f3 AS (SELECT source, word, count(DISTINCT left(text, 500)) = 1 AS first3_share FROM o WHERE rn <= 3 GROUP BY 1, 2),
    f0 AS (SELECT source, word, left(text, 2000) AS p0 FROM o WHERE rn = 1),
    al AS (SELECT o.source, o.word, count(*) AS n, bool_and(left(text, length(p0)) = p0) AS all_share FROM o JOIN f0 ON f0.source = o.source AND f0.word = o.word GROUP BY 1, 2)
    SELECT al.source, md5(al.word) AS session, n, all_share, first3_share FROM al JOIN f3 ON f3.source = al.source AND f3.word = al.word WHERE n >= 2""",
)
def a22(spark, sf):
    d = docs(spark, sf).select("source", F.left("text", F.lit(60)).alias("word"), "doc_id", "text")
    out = reuse.prefix_verified(d, ["source", "word"], "doc_id", "text")
    return out.select("source", F.md5("word").alias("session"), "n", "all_share", "first3_share")


@query(
    "a23_first_pair_shared_blocks",
    f"""WITH grp AS (SELECT source, lang, doc_id, {sql_words('text')} AS w FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rn FROM grp),
    b AS (SELECT source, lang, rn, list_transform(range(0, CAST(greatest(1, ceil(len(w) / 384.0)) AS BIGINT)), lambda k: array_to_string(w[k * 384 + 1 : k * 384 + 384], ' ')) AS bl FROM o WHERE rn <= 2)
    SELECT x.source, x.lang, CAST(len(list_filter(range(1, greatest(len(x.bl), len(y.bl)) + 1), lambda i: x.bl[i] = y.bl[i])) AS BIGINT) AS shared_blocks
    FROM b x JOIN b y ON x.source = y.source AND x.lang = y.lang AND x.rn = 1 AND y.rn = 2""",
)
def a23(spark, sf):
    return reuse.first_pair_shared_blocks(docs(spark, sf), ["source", "lang"], "doc_id", tx.word_block_hashes(F.col("text")))


@query(
    "a45_file_summary",
    f"""WITH {_dist_sql('documents', 'source', 'length(text)')}, {_COPIES} SELECT round(min(chars_p99) / 4.0::DOUBLE, 6) AS p99_min, round(max(chars_p99) / 4.0::DOUBLE, 6) AS p99_max,
    count(*) AS files, (SELECT count(*) FROM copies WHERE unique_exact = rows) AS unique_files FROM dist""",
)
def a45(spark, sf):
    d = docs(spark, sf)
    return rounded(
        reuse.file_summary(reuse.length_distribution(d, ["source"], F.length("text")), reuse.exact_copies(d, ["source"], "text"), "source"),
        "p99_min", "p99_max",
    )


@query("t02_heaviest_files", "SELECT source, round(avg(length(text)) / 4, 6) AS tokens_mean FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def t02(spark, sf):
    return rounded(reuse.heaviest_files(reuse.length_distribution(docs(spark, sf), ["source"], F.length("text")), "source"), "tokens_mean")


@query(
    "x11_reuse_report",
    f"""WITH {_REUSE}, {_dist_sql('grp', 'source, word', 'length(text)').replace('GROUP BY 1)', 'GROUP BY 1, 2)')},
    cp AS (SELECT source, word, count(*) AS unique_exact, CAST(sum(CASE WHEN c > 1 THEN c - 1 ELSE 0 END) AS BIGINT) AS extra_rows, count(*) FILTER (WHERE c > 1) AS groups_2plus
      FROM (SELECT source, word, sha256(text) AS h, count(*) AS c FROM grp GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT rep.*, unique_exact, extra_rows, groups_2plus, round(chars_mean, 6) AS chars_mean, CAST(chars_p50 AS DOUBLE) AS chars_p50, CAST(chars_p90 AS DOUBLE) AS chars_p90,
      CAST(chars_p99 AS DOUBLE) AS chars_p99, CAST(chars_max AS DOUBLE) AS chars_max, round(chars_mean / 4, 6) AS tokens_mean, round(chars_p99 / 4.0::DOUBLE, 6) AS tokens_p99
    FROM rep JOIN dist USING (source, word) JOIN cp USING (source, word)""",
)
def x11(spark, sf):
    d = docs(spark, sf).select("source", _first_word(), "text", "lang")
    out = reuse.reuse_report(d, ["source", "word"], "text", "lang")
    return rounded(out, "suffix_mean", "savings", "chars_mean", "tokens_mean", "tokens_p99")
