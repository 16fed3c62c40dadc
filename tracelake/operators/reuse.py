"""Prompt-reuse analytics: length distributions, exact copies, shared prefixes, prefill savings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import CHARS_PER_TOKEN, words
from tracelake.operators.ordered import null_safe_join
from tracelake.operators.quantiles import floor_index, order_statistics, upper_median

# Prefix lengths that count as partial reuse (label / savings).
PARTIAL_LABEL_CHARS, PARTIAL_SAVING_CHARS = 100, 500
CHECK_CHARS, STRICT_CHARS = 500, 2000


def length_distribution(df: DataFrame, keys: Sequence[str], chars: Column) -> DataFrame:
    """n, mean, floor-index percentiles, max and token estimates of a length, per key."""
    out = order_statistics(
        df.select(*keys, chars.alias("chars")), keys, "chars",
        [upper_median("chars_p50"), floor_index("chars_p90", 90), floor_index("chars_p99", 99)],
    )
    return out.select(
        *keys, "n", F.col("mean").alias("chars_mean"), "chars_p50", "chars_p90", "chars_p99", F.col("max").alias("chars_max"),
        (F.col("mean") / CHARS_PER_TOKEN).alias("tokens_mean"), (F.col("chars_p99") / CHARS_PER_TOKEN).alias("tokens_p99"),
    )


def exact_copies(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Distinct texts, extra copies and groups of two or more; only digests are shuffled."""
    per_text = df.groupBy(*keys, F.sha2(text, 256).alias("__h")).agg(F.count(F.lit(1)).alias("c"))
    return per_text.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("unique_exact"),
        F.sum("c").alias("rows"),
        F.sum(F.when(F.col("c") > 1, F.col("c") - 1).otherwise(0)).alias("extra_rows"),
        F.count_if(F.col("c") > 1).alias("groups_2plus"),
    )


def common_prefix_length(a: Column, b: Column) -> Column:
    """Number of leading characters two strings share."""
    n = F.least(F.length(a), F.length(b))
    same = F.zip_with(F.split(F.left(a, n), ""), F.split(F.left(b, n), ""), lambda x, y: x == y)
    return F.when(n == 0, F.lit(0)).when(a == b, n).otherwise(
        F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, n)
    ).cast("long")


def shared_prefix(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Length of the prefix all texts of a key share.

    Every text lies between the smallest and the largest in byte order, so the prefix those two
    share is shared by all; minimum and maximum combine map-side.
    """
    ends = df.groupBy(*keys).agg(
        F.min(text).alias("__lo"), F.max(text).alias("__hi"), F.count(F.lit(1)).alias("n"),
        F.max(F.length(text)).alias("max_chars"), F.sum(F.length(text)).alias("sum_chars"),
    )
    return ends.select(
        *keys, "n", common_prefix_length(F.col("__lo"), F.col("__hi")).alias("prefix_chars"), "max_chars", "sum_chars"
    )


def prefix_reuse(df: DataFrame, keys: Sequence[str], text: str, instruction: str) -> DataFrame:
    """Reuse class and prefill saving per key, from one aggregate over the texts."""
    base = shared_prefix(df, keys, text)
    inst = df.groupBy(*keys).agg(F.sum(F.length(instruction)).alias("inst_chars"))
    d = null_safe_join(base, inst, list(keys))
    p, n = F.col("prefix_chars"), F.col("n")
    full = (p > 0) & (F.col("max_chars") == p)
    suffix = F.col("sum_chars") - n * p
    naive = F.col("sum_chars") + F.col("inst_chars")
    partial = p + suffix + F.col("inst_chars")
    best = F.when(full, p + F.col("inst_chars")).when(p > PARTIAL_SAVING_CHARS, partial).otherwise(naive)
    return d.select(
        *keys, "n", "prefix_chars", (suffix / n).alias("suffix_mean"),
        F.when(full, "HIGH_REUSE").when(p > PARTIAL_LABEL_CHARS, "PARTIAL_REUSE").otherwise("LOW_REUSE").alias("reuse"),
        naive.alias("naive_chars"), best.alias("optimized_chars"),
        F.when(full | (p > PARTIAL_SAVING_CHARS), 1 - best / F.greatest(naive, F.lit(1))).otherwise(0.0).alias("savings"),
    )


def document_groups(df: DataFrame, keys: Sequence[str], doc: str, context: str, pos: str) -> DataFrame:
    """Per document: questions, whether the context length is uniform, length of the first context."""
    n = F.length(context)
    return df.groupBy(*keys, doc).agg(
        F.count(F.lit(1)).alias("questions"), F.sum(n).alias("naive_chars"),
        (F.min(n) == F.max(n)).alias("uniform"), F.min_by(n, pos).alias("first_chars"),
    )


def document_reuse(df: DataFrame, keys: Sequence[str], doc: str, context: str, pos: str) -> DataFrame:
    """Documents, questions per document and documents with one context length."""
    docs = document_groups(df, keys, doc, context, pos)
    base = docs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("documents"), F.sum("questions").alias("rows"),
        F.mean("questions").alias("questions_mean"), F.max("questions").alias("questions_max"),
        F.count_if("uniform").alias("uniform_documents"),
    )
    ranks = [upper_median("questions_p50"), floor_index("questions_p90", 90), floor_index("questions_p99", 99)]
    spread = order_statistics(docs, keys, "questions", ranks).select(*keys, *[r.name for r in ranks])
    return null_safe_join(base, spread, list(keys), "left")


def prefill_savings(df: DataFrame, keys: Sequence[str], doc: str, context: str, pos: str) -> DataFrame:
    """Context characters with and without one prefill per document."""
    docs = document_groups(df, keys, doc, context, pos)
    agg = docs.groupBy(*keys).agg(
        F.sum("naive_chars").alias("naive_chars"), F.sum("first_chars").alias("unique_chars"),
        F.sum("questions").alias("rows"), F.count(F.lit(1)).alias("documents"),
    )
    return agg.withColumns(
        {
            "savings": 1 - F.col("unique_chars") / F.greatest("naive_chars", F.lit(1)),
            "queries_per_prefill": F.col("rows") / F.greatest("documents", F.lit(1)),
        }
    )


def mean_length_ratio(df: DataFrame, keys: Sequence[str], part: str, whole: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        (F.mean(F.length(part)) / F.greatest(F.mean(F.length(whole)), F.lit(1.0))).alias("ratio")
    )


def text_statistics(df: DataFrame, keys: Sequence[str], text: str, kind: str, doc: str) -> DataFrame:
    """Rows, mean characters, distinct kinds and distinct documents per key."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_rows"), F.mean(F.length(text)).alias("avg_chars"),
        F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"),
        F.count_distinct(F.nullif(F.col(doc).cast("string"), F.lit(""))).alias("unique_docs"),
    )


def class_rollup(df: DataFrame, cls: str, file: str) -> DataFrame:
    """Row counts per class and file, per class, and in total."""
    return df.rollup(cls, file).agg(F.count(F.lit(1)).alias("num_rows"), F.grouping_id().alias("level"))


def session_statistics(df: DataFrame, session: str, keys: Sequence[str] = ()) -> DataFrame:
    """Sessions and sessions with two or more requests; rows without a session do not count."""
    per = df.filter(F.col(session).isNotNull()).groupBy(*keys, session).agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("c") >= 2).alias("sessions_2plus"))


def prefix_verified(df: DataFrame, session: Sequence[str], pos: str, text: str) -> DataFrame:
    """Per session with two or more requests: do the first three share 500 characters, and do all
    share the first request's leading 2000? The second follows from the common prefix of min and max."""
    from pyspark.sql import Window

    keys = list(session)
    head = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(pos))).filter("__rn <= 3")
    first3 = head.groupBy(*keys).agg((F.count_distinct(F.left(text, F.lit(CHECK_CHARS))) == 1).alias("first3_share"))
    cut = F.left(text, F.lit(STRICT_CHARS))
    whole = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(cut).alias("__lo"), F.max(cut).alias("__hi"),
        F.min_by(F.length(cut), pos).alias("__len0"),
    ).filter("n >= 2")
    strict = common_prefix_length(F.col("__lo"), F.col("__hi")) >= F.col("__len0")
    return null_safe_join(whole.select(*keys, "n", strict.alias("all_share")), first3, keys)


def first_pair_shared_blocks(df: DataFrame, session: Sequence[str], pos: str, blocks: Column) -> DataFrame:
    """Equal hash blocks, position by position, of the first two requests of each session."""
    from pyspark.sql import Window

    keys = list(session)
    first2 = (
        df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(pos)))
        .filter("__rn <= 2")
        .withColumn("__b", blocks)
    )
    pair = first2.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("__b", "__rn").alias("a"), F.max_by("__b", "__rn").alias("b")
    ).filter("n = 2")
    shared = F.size(F.filter(F.arrays_zip("a", "b"), lambda z: z["a"].eqNullSafe(z["b"])))
    return pair.select(*keys, shared.cast("long").alias("shared_blocks"))


def file_summary(dist: DataFrame, copies: DataFrame, file: str) -> DataFrame:
    """One row over all files: range of p99 tokens and number of files without any copy."""
    d = dist.agg(F.min("tokens_p99").alias("p99_min"), F.max("tokens_p99").alias("p99_max"), F.count(F.lit(1)).alias("files"))
    u = copies.agg(F.count_if(F.col("unique_exact") == F.col("rows")).alias("unique_files"))
    return d.withColumn("unique_files", u.scalar())


def heaviest_files(dist: DataFrame, file: str, k: int = 5) -> DataFrame:
    return dist.select(file, "tokens_mean").orderBy(F.desc("tokens_mean"), file).limit(k)


def reuse_report(df: DataFrame, keys: Sequence[str], text: str, instruction: str) -> DataFrame:
    """Length distribution, exact copies and prefix reuse side by side."""
    keys = list(keys)
    dist = length_distribution(df, keys, F.length(text))
    copies = exact_copies(df, keys, text).drop("rows")
    prefix = prefix_reuse(df, keys, text, instruction).drop("n")
    return null_safe_join(null_safe_join(dist, copies, keys), prefix, keys)


def character_statistics(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Characters, words and characters per word of each row."""
    w = F.size(words(F.col(text))).cast("long")
    return df.select(
        *keys, F.length(text).cast("long").alias("chars"), w.alias("words"),
        (F.length(text) / F.greatest(w, F.lit(1))).alias("chars_per_word"),
    )
