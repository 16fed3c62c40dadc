"""Quality rules with risk-controlled thresholds.

Every text gets counts (words, symbols, lines that repeat, words in repeated three-word windows); rules turn them into
levels, whole numbers that grow as a text gets worse. A text above a rule's cutoff is rejected. Cutoffs come from
labelled rows, per stratum (language): for each rule the strictest cutoff is taken at which the share of good
texts that it rejects is below ``RISK / number of rules``, shown by an exact binomial test: with ``n`` good
texts of which ``k`` are above the cutoff, P(X <= k) for X ~ Binomial(n, share) must be at most ``DELTA`` over the
number of (rule, stratum) pairs (Bonferroni). Cutoffs of a rule are tested from the loosest on and the first that
fails ends the sequence, which needs no further correction. So with probability ``1 - DELTA`` no stratum loses
more than ``RISK`` of its good texts to all rules together. Where labels are too few, nothing passes the test and the
rule rejects nothing there.

Only built-in functions are used; a text is read once, and later steps see counts only.

Defined cases: a null or empty text has no words, fails the base rule and has level 0 elsewhere; a null language is
a stratum; labels that are null or of unknown ids are not used, a doc_id labelled twice is good if all labels say
so; repeated rows are judged each; empty tables give an empty result or no cutoffs; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.catalog import documents, query
from tracelake.session import stage

RISK = 0.02
DELTA = 0.05
MIN_WORDS = 50
TOP_LEVEL = 1000
#: A table of strata up to this many rows is sent to every task; a larger one is joined by key, and skewed keys are split.
SMALL = 10_000
#: Level of each rule: per mille of words or lines, or hundredths of characters from the usual length of a word.
RULES = {
    "symbols": "n_symbols * 1000 div greatest(n_words, 1)",
    "repeats": "n_repeat_words * 1000 div greatest(n_words, 1)",
    "dup_lines": "n_dup_lines * 1000 div greatest(n_lines, 1)",
    "word_length": "CASE WHEN n_words = 0 THEN 0 ELSE abs(word_chars * 100 div n_words - 550) END",
}


def count_text(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and the counts of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*keep, text.alias("__text"), F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)).alias("__words"))
    rows = rows.select(
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.translate("__text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("__text", "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")).alias("__lines"),
        F.expr("""CASE WHEN size(__words) >= 4 THEN
          transform(sequence(0, size(__words) - 3), i -> xxhash64(__words[i], __words[i + 1], __words[i + 2])) END""").alias("__windows"),
    )
    repeated = "size(array_distinct(__windows)) < size(__windows)"
    rows = rows.select(
        *keep, "n_words", "word_chars", "n_symbols",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        # windows by value, then place: equal ones are neighbours
        F.expr(f"CASE WHEN {repeated} THEN array_sort(transform(__windows, (h, i) -> struct(h AS h, i AS i))) END").alias("__sorted"),
    )
    places = """array_sort(filter(transform(__sorted, (x, k) ->
        CASE WHEN x.h = get(__sorted, k - 1).h OR x.h = get(__sorted, k + 1).h THEN x.i END), i -> i IS NOT NULL))"""
    # a word counts once, however many repeated windows hold it
    covered = f"aggregate({places}, struct(-3 AS last, 0L AS n), (a, i) -> struct(i AS last, a.n + least(3, i - a.last) AS n), a -> a.n)"
    return rows.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.expr(f"CASE WHEN __sorted IS NULL THEN 0L ELSE {covered} END").alias("n_repeat_words"),
    )


def _levels() -> list[Column]:
    return [F.least(F.expr(rule), F.lit(TOP_LEVEL)).cast("int").alias(f"level_{name}") for name, rule in RULES.items()]


def _log_gamma(x: str) -> str:
    """Stirling's series after a shift by 12, where its error is below double precision."""
    shift = " + ".join(f"ln({x} + {k})" for k in range(12))
    y = f"({x} + 12)"
    series = f"1 / (12 * {y}) - 1 / (360 * pow({y}, 3)) + 1 / (1260 * pow({y}, 5)) - 1 / (1680 * pow({y}, 7))"
    return f"(({y} - 0.5D) * ln({y}) - {y} + {0.5 * math.log(2 * math.pi)!r}D + {series} - ({shift}))"


def binomial_below(n: str, k: str, share: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, share), for k below the mean: the last term times a falling series."""
    n, k = f"CAST({n} AS DOUBLE)", f"CAST({k} AS DOUBLE)"
    term = f"""exp({_log_gamma(f'({n} + 1)')} - {_log_gamma(f'({k} + 1)')} - {_log_gamma(f'({n} - {k} + 1)')}
        + {k} * {math.log(share)!r}D + ({n} - {k}) * {math.log1p(-share)!r}D)"""
    odds = (1 - share) / share
    steps = f"sequence(0, CAST(least({k}, ceil(40 * sqrt({n}))) AS INT))"
    series = f"""aggregate({steps}, struct(1D AS t, 0D AS s),
        (a, i) -> struct(a.t * ({k} - i) * {odds!r}D / ({n} - {k} + i + 1) AS t, a.s + a.t AS s), a -> a.s)"""
    return F.expr(f"{term} * {series}")


def cutoffs(levels: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff): the strictest level at which each rule may reject; no row where none may."""
    good = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("__good")).where("__good = 1")
    )
    share = risk / len(RULES)
    stack = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"level_{name}").alias("level")) for name in RULES]))
    counted = (
        levels.join(good, "doc_id", "left_semi").select("stratum", stack.alias("r")).groupBy("stratum", "r.rule", "r.level")
        .agg(F.count("*").alias("n"))
    )
    # every cutoff from the top level down: rejected are the good texts above it
    per_rule = counted.groupBy("stratum", "rule").agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("level")).alias("down"), F.col("n").alias("n")))).alias("seen")
    )
    pairs = per_rule.agg(F.count("*").alias("pairs"))
    walk = """aggregate(seen, struct(0L AS above, array() AS steps),
        (a, x) -> struct(a.above + x.n AS above, array_append(a.steps, struct(CAST(-x.down AS INT) AS cutoff, a.above AS k)) AS steps), a -> a.steps)"""
    walk = walk.replace("array() AS steps", "CAST(array() AS ARRAY<STRUCT<cutoff: INT, k: BIGINT>>) AS steps")
    tested = per_rule.select("stratum", "rule", "n", F.explode(F.expr(walk)).alias("s")).select("stratum", "rule", "n", "s.cutoff", "s.k")
    passed = tested.where(F.col("k") < F.col("n") * share).withColumn("p", binomial_below("n", "k", share)).join(F.broadcast(pairs))
    return passed.where(F.col("p") <= delta / F.col("pairs")).groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Counts, levels, ``base_failed``, the rules that reject (``failed``) and ``kept`` of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("stratum"), "text")
    levels = stage(count_text(rows, "doc_id", "stratum").select("*", *_levels()), "levels")
    chosen = cutoffs(levels, labels, risk, delta).groupBy(F.col("stratum").alias("__stratum")).agg(
        *[F.min(F.when(F.col("rule") == name, F.col("cutoff"))).alias(f"cut_{name}") for name in RULES]
    )
    chosen = stage(chosen, "cutoffs")
    few = chosen.limit(SMALL + 1).count() <= SMALL
    joined = levels.join(F.broadcast(chosen) if few else chosen, F.col("stratum").eqNullSafe(F.col("__stratum")), "left")
    failed = F.concat_ws(",", *[F.when(F.col(f"level_{name}") > F.col(f"cut_{name}"), F.lit(name)) for name in RULES])
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return joined.withColumn("base_failed", base).withColumn("failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("failed") == "")
    ).drop("__stratum", *[f"cut_{name}" for name in RULES])


_SQL = f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
             [l FOR l IN string_split(t, chr(10)) IF regexp_matches(l, '[^\\x20\\x09-\\x0D]')] AS lines FROM d),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
counts AS (
  SELECT w.doc_id, lang, len(w)::BIGINT AS n_words, list_sum([length(x) FOR x IN w])::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
lev AS (
  SELECT *, least(1000, n_symbols * 1000 // greatest(n_words, 1)) AS symbols, least(1000, n_repeat_words * 1000 // greatest(n_words, 1)) AS repeats,
         least(1000, n_dup_lines * 1000 // greatest(n_lines, 1)) AS dup_lines,
         CASE WHEN n_words = 0 THEN 0 ELSE least(1000, abs(word_chars * 100 // n_words - 550)) END AS word_length
  FROM counts),
long AS (UNPIVOT lev ON symbols, repeats, dup_lines, word_length INTO NAME rule VALUE level),
good AS (SELECT * FROM long WHERE doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1)),
sized AS (SELECT lang, rule, level AS cutoff, count(*) OVER (PARTITION BY lang, rule) AS n,
                 count(*) OVER (PARTITION BY lang, rule ORDER BY level DESC RANGE UNBOUNDED PRECEDING)
                 - count(*) OVER (PARTITION BY lang, rule, level) AS k FROM good),
tests AS (SELECT DISTINCT *, (SELECT count(*) FROM (SELECT DISTINCT lang, rule FROM good)) AS pairs FROM sized WHERE k < n * {RISK / len(RULES)!r}),
cuts AS (
  SELECT lang, rule, min(cutoff) AS cut FROM tests
  WHERE list_sum([exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({RISK / len(RULES)!r}) + (n - j) * ln(1 - {RISK / len(RULES)!r}))
                  FOR j IN range(0, k + 1)]) <= {DELTA!r} / pairs
  GROUP BY lang, rule),
bad AS (SELECT doc_id, count(*) AS n FROM long JOIN cuts ON cuts.lang IS NOT DISTINCT FROM long.lang AND cuts.rule = long.rule AND level > cut GROUP BY doc_id)
SELECT c.doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND bad.n IS NULL AS kept
FROM counts c LEFT JOIN bad ON bad.doc_id = c.doc_id
"""


@query("op9_quality_rules", _SQL)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
