"""Line dedup, divergence audit and collocations against brute force, on awkward rows and on skewed tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from freightlens.llm import collocations, divergence, line_dedup

DOCS = "doc_id long, text string, lang string, source string, n_lines long, gone string, line_gone string, kept_lines string, line_doc string, `key` string, w1 string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def docs_of(spark, rows):
    """Rows of (doc_id, text, lang, source) with further columns that operators use as names of their own."""
    return spark.createDataFrame([(*r, 7, "g", "lg", "kl", "ld", "k", "w") for r in rows], DOCS)


LONG = "\n".join(f"line number {i % 700} of a long text, it goes On; and on" for i in range(20_000))
ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \n\t \n", "en", None),
    (None, "a line without an id\nline number 5 of a long text, it goes on; and on", "en", "a"),
    (None, "a line without an id\nanother line", "en", "a"),
    (9, "Same line of words\n  same line of WORDS \r\n\nshort", "en", "a"),
    (4, "same line of words\nÉcole fermée ici\nshort", "en", "b"),
    (4, "same line of words\nécole fermée ici\nshort", "en", "b"),
    (5, "école fermée ici\t\nÉCOLE fermée ici\nshort\n", None, "b"),
    (6, LONG, "en", "a"),
    (7, LONG + "\nend of it", "", ""),
    (7, LONG + "\nend of it", "", ""),
]


# --- lines -------------------------------------------------------------------------------
def brute_lines(rows, min_points=10):
    def key(line):
        return lower(line.strip(" \t\n\x0b\x0c\r"))

    def place(i):
        return (i is None, i or 0)

    owner = {}
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            k = key(line)
            owner[k] = min(owner.get(k, place(i)), place(i))
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_points or owner[key(x)] == place(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def kept_rows(df, **settings):
    got = line_dedup.with_kept_lines(df, "k", **settings).select("doc_id", "k.n_lines", "k.n_dropped", "k.text").collect()
    return sorted([tuple(r) for r in got], key=repr)


@pytest.mark.parametrize("batches, fanout", [(1, 2), (5, 2), (6, 3)])
def test_lines_of_awkward_rows(spark, batches, fanout):
    assert kept_rows(docs_of(spark, ODD), batches=batches, fanout=fanout) == brute_lines(ODD)


def test_lines_do_not_depend_on_batches_or_hot_share(spark, root, monkeypatch):
    docs = spark.read.parquet(f"{root}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_lines(rows)
    assert kept_rows(docs, batches=4, fanout=2) == want
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 3)
    assert kept_rows(docs, batches=2) == want


def test_lines_keep_clashing_columns(spark):
    df = docs_of(spark, ODD)
    out = line_dedup.drop_repeated_lines(df)
    assert out.columns == df.columns and out.count() == len(ODD)
    assert {tuple(r)[4:] for r in out.collect()} == {(7, "g", "lg", "kl", "ld", "k", "w")}


def test_runs_are_compacted(spark):
    runs = line_dedup.Runs(spark, fanout=2)
    for i in range(5):
        hashes = spark.range(i * 10, i * 10 + 20).select(F.col("id").alias("h1"), F.col("id").alias("h2"), F.lit(i).cast("long").alias("owner"))
        new = runs.add(hashes)
        assert new.count() == (20 if i == 0 else 10)
        runs.compact()
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert sum(spark.table(n).count() for level in runs.levels for n in level) == 60
    runs.close()


def test_merging_a_run_moves_only_the_batch(spark):
    runs = line_dedup.Runs(spark)
    hashes = spark.range(100).select(F.col("id").alias("h1"), F.col("id").alias("h2"), F.col("id").alias("owner"))
    runs.add(hashes)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = runs.unknown(hashes)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        runs.close()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1


def test_line_digest_of_the_query(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet")
    want = {(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute_lines([(r.doc_id, r.text) for r in docs.collect()])}
    assert {tuple(r) for r in line_dedup.op13(spark, root).collect()} == want


# --- divergence --------------------------------------------------------------------------
TERM = re.compile(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute_audit(rows, min_docs, top=10):
    uses, in_docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall(lower(text))
        uses[lang, source].update(terms)
        in_docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in in_docs[lang].items() if n >= min_docs]
        own = [s for g, s in sorted(groups) if g == lang]
        v = len(kept)

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * v) for t in kept}

        whole = shares(sum((uses[lang, s] for s in own), Counter()))
        p = {s: shares(uses[lang, s]) for s in own}

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in own:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in own if o != s]
            terms = [(t, f(p[s][t], whole[t])) for t in kept if uses[lang, s][t] and p[s][t] > whole[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(items[:most], 1)]
    return sorted(out)


def rows_sorted(df):
    return sorted(tuple(r) for r in df.collect())


def test_audit_of_the_tables(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    assert rows_sorted(divergence.op12(spark, root)) == brute_audit(rows, 10)


@pytest.mark.parametrize("min_docs", [1, 2, 10, 100])
def test_audit_of_awkward_rows(spark, min_docs):
    rows = ODD + [(10, None, "xx", "empty"), (11, "Zebra zebra", "xx", "full"), (12, "", "xx", None), (13, "ÀB\x00àb zebra1zebra", "xx", "c")]
    assert rows_sorted(divergence.audit(docs_of(spark, rows), min_docs)) == brute_audit(rows, min_docs)


def test_audit_in_small_blocks_and_tiles(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"t{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}" for k in rng.zipf(1.3, 200) % 100), "en", f"s{i % 7 if i % 3 else 0}") for i in range(120)]
    want = brute_audit(rows, 3)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 5)
    assert rows_sorted(divergence.audit(docs_of(spark, rows), 3)) == want


def test_a_block_is_the_same_in_tiles(monkeypatch):
    rng = np.random.default_rng(5)
    level = rng.integers(0, 40, (60, 5)).astype(np.int64)
    totals = level.sum(axis=0).tolist()
    whole = divergence._block("en", list("abcde"), totals, 60, level)
    monkeypatch.setattr(divergence, "TILE", 7)
    assert divergence._block("en", list("abcde"), totals, 60, level).equals(whole)
    p = [[1 + 10**9 * (int(c) + 2) // (t + 120) for c in level[:, j]] for j, t in enumerate(totals)]
    want = {(a, b): sum((x - y) ** 2 // (x + y) for x, y in zip(p[i], p[j])) for i, a in enumerate("abcde") for j, b in enumerate("abcde") if i < j}
    assert {(r["source"], r["item"]): r["value"] for r in whole.to_pylist()} == want


# --- collocations ------------------------------------------------------------------------
def brute_phrases(rows, least, percent=100, top=2000):
    total, f = Counter(), defaultdict(Counter)
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        total[lang] += 0
        for piece in re.split(r"[.,;:!?\n-\r]", lower(text)):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang in f:
        n, c = total[lang], f[lang]
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inner = {}
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inner[p[i : i + k]] = max(inner.get(p[i : i + k], 0), a)
        best = []
        for p, a in found.items():
            if 100 * inner.get(p, 0) >= percent * a:
                continue
            score, _, l, r = min((1000 * a * n // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), l, r))
        best.sort()
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(best[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("least, percent, top", [(1, 100, 50), (2, 100, 2000), (5, 60, 2000), (100, 100, 2000)])
def test_phrases_of_awkward_rows(spark, least, percent, top):
    rows = ODD + [(20 + i, "New York city hall, new york City Hall! New\tYork is New York is", "en" if i % 2 else None, "a") for i in range(7)]
    got = collocations.phrases(docs_of(spark, rows), collocations.Settings(least, percent, top))
    assert rows_sorted(got) == brute_phrases(rows, least, percent, top)


def test_phrases_of_the_tables(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    assert rows_sorted(collocations.phrases(docs, collocations.Settings(least=20))) == brute_phrases(rows, 20)


def test_scores_pass_64_bits(spark):
    windows = [("en", 3_000_000_000, 1, 2), ("en", 4_000_000_000, 1, None), ("en", 4_000_000_000, 2, None), ("en", 10**13, 3, None)]
    df = spark.createDataFrame([(lang, a, b, None, None, None, n) for lang, n, a, b in windows], "lang string, " + ", ".join(f"w{i} long" for i in range(1, 6)) + ", n long")
    counts = {(r.k, tuple(r.words)): r.n for r in collocations.phrase_counts(df, 100).collect()}
    assert counts == {
        (0, ()): 10**13 + 11_000_000_000, (1, (1,)): 7_000_000_000, (1, (2,)): 4_000_000_000, (1, (3,)): 10**13, (2, (1, 2)): 3_000_000_000,
    }


def test_empty_tables(spark):
    empty = docs_of(spark, [])
    assert line_dedup.drop_repeated_lines(empty).collect() == []
    assert divergence.audit(empty).collect() == []
    assert collocations.phrases(empty).collect() == []
