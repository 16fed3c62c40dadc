import math
import random
import re

from tracelake.llm import license_join as lic

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, threshold=lic.THRESHOLD):
    out = []
    for d, text in rows:
        w = words(text)
        places = [(i, label) for p, label in lic.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        base = {x for _, x in places}
        labels, score = set(base), float(bool(places))
        blocks = []
        for k, line in enumerate((text or "").split("\n")):
            own = {}
            for name, template in lic.TEMPLATES.items():
                t = set(words(template))
                share = len(t & set(words(line))) / len(t)
                if share * len(t) >= math.ceil(threshold * len(t) - 1e-9):
                    own[name] = (t, share)
            for name, (t, share) in own.items():
                if any((t < u and other >= share) or (u < t and other > share) for u, other in own.values()):
                    continue
                labels.add(name)
                score = max(score, share)
                blocks.append((k, name, round(share, 9)))
        start = [i for i, _ in places]
        out.append((d, len(w), len(places), min(start, default=None), max(start, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9), sorted(blocks)))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "doc_id long, text string, labels string, score double")
    return sorted(((*r[:7], round(r.score, 9), sorted((b.line, b.template, round(b.similarity, 9)) for b in r.blocks)) for r in lic.scan(docs).collect()), key=str)


def test_matches_comparison_of_every_line_on_the_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert any(r[2] for r in want) and run(spark, rows) == want


def test_texts_cut_from_templates(spark):
    rng = random.Random(4)
    rows = []
    for d in range(300):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            w = rng.choice(list(lic.TEMPLATES.values())).split()
            w = [x for x in w if rng.random() < 0.9] + [rng.choice(["noise", "the", "CC", "by", "License"]) for _ in range(rng.randrange(6))]
            rng.shuffle(w)
            parts.append(rng.choice([" ", "\n", "\n\n"]).join([" ".join(w), rng.choice(["CC-BY", "cc\nby 4.0", "ALL RIGHTS (reserved)", "all rights", ""])]))
        rows.append((d, "\n".join(parts)))
    assert run(spark, rows) == brute(rows)


def test_licenses_that_differ_by_a_word_are_told_apart(spark):
    names = ("gpl-3.0", "lgpl-3.0", "cc-by-4.0", "cc-by-sa-4.0", "mit", "isc")
    rows = [(k, lic.TEMPLATES[n]) for k, n in enumerate(names)] + [(9, lic.TEMPLATES["mit"] + " " + lic.TEMPLATES["gpl-3.0"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.labels for r in lic.scan(docs, phrases={}).collect()}
    assert got == {**dict(enumerate(names)), 9: "gpl-3.0,mit"}


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, "All rights reserved. all rights reserved"), (4, "é CC BY " * 30000), (5, "cc"), (6, "by the"), (4, "cc by")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    none = lic.scan(spark.createDataFrame([(1, "cc by")], "doc_id long, text string"), templates={"x": "?!"}).collect()
    assert [(r.labels, r.score) for r in none] == [("cc-by", 1.0)]
