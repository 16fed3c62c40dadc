"""Secret scans over an incremental blob ledger.

A version of a file is addressed by the digest of its text; equal texts, whatever their paths, are one blob. The
ledger is a table in a folder: per scan of a blob, the rules (name and version) that were run and what they found. A
scan looks up which (blob, rule version) pairs are missing, reads the text of one version of each such blob, runs only the
missing rules, appends to the ledger, and joins findings back to every path. New versions of old texts cost a
lookup; a new version of one rule costs that rule.

Rules are regular expressions; ``base`` ones follow a fixed definition (leftmost matches that do not overlap, then a
length), the others add kinds of their own. Spans are code points, end exclusive. Only built-in functions are used.
Texts are shuffled once, by the key of the version chosen to be read, never by content, so copies do not meet;
the join back to paths has one small row per blob, and adaptive execution splits a blob with very many paths.

Defined cases: a null text is empty, without findings; repeated rows are reported each; two texts under one key are
two blobs; a null key is a key; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.catalog import documents, query
from tracelake.session import scratch_dir, stage


@dataclass(frozen=True)
class Rule:
    """``hint``: a condition on a text that any text with a match meets, cheaper than the pattern; ``check``: on a match."""

    name: str
    version: int
    pattern: str
    hint: Callable[[Column], Column] = lambda text: F.lit(True)
    check: Callable[[Column], Column] = lambda match: F.lit(True)

    @property
    def id(self) -> str:
        return f"{self.name}@{self.version}"


def _has(*parts: str) -> Callable[[Column], Column]:
    return lambda text: reduce(Column.__or__, [F.contains(text, F.lit(p)) for p in parts])


# The base kinds, in the order in which they are listed.
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    Rule("assign", 1, _ASSIGN, _has("=", ":"), lambda m: F.length(F.regexp_extract(m, _ASSIGN, 2)) >= 8),
    # for these two a shorter run holds no match, so the length may stand in the pattern
    Rule("access", 1, "AKIA[A-Z0-9]{12,}", _has("AKIA")),
    Rule("hex", 1, "[0-9a-f]{32,}"),
)
MORE = (
    Rule("private_key", 1, "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", _has("-----BEGIN")),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", _has("eyJ")),
    Rule("forge_token", 1, "gh[opsu]_[A-Za-z0-9]{36,}", _has("gh")),
    Rule("url_login", 1, r"[a-z]{2,10}://[^\s:/@]{1,80}:[^\s:/@]{1,80}@", _has("://")),
)
RULES = BASE + MORE
_FINDINGS = "array<struct<rule: string, start: int, end: int>>"
_STATE = "array<struct<start: int, end: int, m: string>>"
LEDGER = f"blob binary, rules array<string>, findings {_FINDINGS}"


def _matches(rule: Rule) -> Column:
    """Matches of a rule in ``text``; null where it was not asked for or the hint fails."""
    wanted = F.array_contains("missing", rule.id) & rule.hint(F.col("text"))
    return F.when(wanted, F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)))


def _spans(rule: Rule, found: str) -> Column:
    """Places of the matches: what lies between them, by splitting at the same pattern, gives the distances."""

    def step(state: Column, x: Column) -> Column:
        start = (state["at"] + x["gap"]).cast("int")
        end = (start + F.length(x["m"])).cast("int")
        one = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"))
        return F.struct(end.alias("at"), F.array_append(state["out"], one).alias("out"))

    gaps = F.slice(F.split("text", rule.pattern, -1), 1, F.size(found))
    parts = F.zip_with(gaps, found, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_STATE).alias("out"))
    placed = F.aggregate(parts, start, step, lambda state: state["out"])
    kept = F.filter(placed, lambda x: rule.check(x["m"]))
    named = F.transform(kept, lambda x: F.struct(F.lit(rule.name).alias("rule"), x["start"].alias("start"), x["end"].alias("end")))
    return F.when(F.size(found) > 0, named)


def find(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rules, findings) of rows (blob, missing, text): runs the missing rules on each text."""
    found = blobs.select("*", *[_matches(r).alias(f"__{r.name}") for r in rules])
    none = F.array().cast(_FINDINGS)
    every = F.concat(*[F.coalesce(_spans(r, f"__{r.name}"), none) for r in rules])
    return found.select("blob", F.col("missing").alias("rules"), every.cast(_FINDINGS).alias("findings"))


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger; an empty one where the folder has none yet."""
    spark.createDataFrame([], LEDGER).coalesce(1).write.mode("append").parquet(folder)
    return spark.read.schema(LEDGER).parquet(folder)



def update(versions: DataFrame, keys: list[str], folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger lacks of ``versions`` (key columns and text) and append it; returns (keys, blob)."""
    spark = versions.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    address = F.unhex(F.sha2(text.cast("binary"), 256))
    addressed = stage(versions.select(*keys, address.alias("blob")), "addresses")
    wanted = F.array(*[F.lit(r.id) for r in rules])
    ledger = read_ledger(spark, folder)
    known = ledger.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("done"))
    blobs = addressed.groupBy("blob").agg(F.min(F.struct(*keys)).alias("at"))
    missing = F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>")))
    todo = blobs.join(known, "blob", "left").select("blob", "at.*", missing.alias("missing")).where(F.size("missing") > 0)
    texts = versions.select(*keys, text.alias("text"))
    # one version of each blob; another text under the same key has another address
    unseen = texts.join(todo, [texts[k].eqNullSafe(todo[k]) for k in keys]).select("blob", "missing", "text")
    unseen = unseen.where(F.unhex(F.sha2(F.col("text").cast("binary"), 256)) == F.col("blob"))
    find(unseen, rules).write.mode("append").parquet(folder)
    return addressed


def per_blob(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, findings) of the given rule versions, each finding once, by start and then in the order of the rules."""
    place = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.name), F.lit(k))])
    current = [F.lit(r.id) for r in rules]
    rows = ledger.where(F.arrays_overlap("rules", F.array(*current)))
    # a row may hold rules that have a newer version since: only its current ones count
    names = F.transform(F.array_intersect("rules", F.array(*current)), lambda r: F.substring_index(r, "@", 1))
    rows = rows.select("blob", "findings", names.alias("names"))
    rows = rows.select("blob", F.filter("findings", lambda x: F.array_contains("names", x["rule"])).alias("findings"))
    found = F.array_distinct(F.flatten(F.collect_list("findings")))
    ordered = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), place[x["rule"]].alias("place"), x["end"].alias("end"), x["rule"].alias("rule"))))
    return rows.groupBy("blob").agg(ordered.alias("findings"))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["rule"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(versions: DataFrame, keys: list[str], folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of every row of ``versions``: keys and ``findings`` (start, place of the rule, end, rule)."""
    addressed = update(versions, keys, folder, rules)
    ledger = read_ledger(versions.sparkSession, folder)
    return addressed.join(per_blob(ledger, rules), "blob").select(*keys, "findings")


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# The same places, from the lengths of matches and of what lies between them.
_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
rules AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{r.name}', {_literal(r.pattern)})" for k, r in enumerate(RULES))}) v(k, kind, pat)),
m AS (SELECT doc_id, k, kind, regexp_extract_all(t, pat) AS ms, string_split_regex(t, pat) AS gaps FROM d, rules),
e AS (SELECT doc_id, k, kind, ms[i] AS m, list_sum([length(g) FOR g IN gaps[1 : i]]) + coalesce(list_sum([length(x) FOR x IN ms[1 : i - 1]]), 0) AS a
      FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m WHERE len(ms) > 0)),
f AS (SELECT doc_id, k, a, kind, kind || ':' || a::BIGINT || ':' || (a + length(m))::BIGINT AS s FROM e WHERE kind <> 'assign' OR length(regexp_extract(m, {_literal(_ASSIGN)}, 2)) >= 8)
SELECT d.doc_id, {", ".join(f"count(*) FILTER (kind = '{r.name}') AS n_{r.name}" for r in BASE)},
  sha256(coalesce(string_agg(s, ',' ORDER BY a, k) FILTER (k < {len(BASE)}), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY a, k), '') AS spans
FROM d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id
"""


@query("op1_blob_secrets", _SQL)
def op1_blob_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    folder = scratch_dir(spark, "ledger")
    addressed = update(docs, ["doc_id"], folder)
    base = [r.name for r in BASE]
    found = per_blob(read_ledger(spark, folder))
    of_base = F.filter("findings", lambda x: x["rule"].isin(base))
    count = lambda name: F.size(F.filter("findings", lambda x: x["rule"] == name)).cast("long").alias(f"n_{name}")
    digests = found.select(
        "blob", *[count(name) for name in base], F.sha2(_joined(of_base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("findings")).alias("spans")
    )
    return addressed.join(digests, "blob").drop("blob")
