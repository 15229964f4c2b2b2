"""Repeated ids, contradicting labels, clashing columns, customary formats, and awkward tables through the pipeline."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from freightlens.llm import decontaminate, minhash_dedup, mixing, pseudonyms, toxicity

from .test_operators import table


def test_texts_of_one_id_link_their_groups(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue black white grey")
    rows = [(5, a), (5, b), (3, b), (9, a), (7, c), (7, ""), (2, c), (None, a), (8, None), (8, a)]
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), minhash_dedup.Settings(k=2)).collect()}
    assert {i: got[i, 5][0] for i in (5, 3, 9, 8)} == {5: 3, 3: 3, 9: 3, 8: 3}
    assert got[7, 5] == (2, False) and got[2, 5] == (2, True) and got[3, 5] == (3, True) and got[8, 0] == (8, True)


def test_contradicting_labels_teach_nothing(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet")
    labels = spark.read.parquet(f"{root}/labels.parquet").select("doc_id", "toxic")
    clean = labels.where("doc_id % 3 <> 0")
    twisted = labels.where("doc_id % 3 = 0").withColumn("toxic", 1 - F.col("toxic"))
    score = lambda known: sorted(map(tuple, toxicity.score(docs, toxicity.fit(docs, known)).select("doc_id", "score").collect()))
    want = score(clean)
    assert score(labels.unionByName(twisted)) == want
    assert score(twisted.unionByName(clean.repartition(3)).unionByName(labels)) == want


KNOWN = {
    "phone": ["212-555-1234", "(212)555-1234", "+1 212-555-1234", "212.555.1234", "+44 20 7946 0958", "(212) 555-1234", "+1 (212) 555-1234"],
    "card": ["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111", "3782 822463 10005", "378282246310005"],
    "date": ["05/06/1980", "1980-05-06"],
    "ip": ["10.2.3.4"],
    "ssn": ["123-45-6789"],
}


@pytest.mark.parametrize("frame", ["call {} now", "{}", "x {}, y", "row 7 {} 12/27", "({})", "{} 123"])
def test_customary_formats_are_found(spark, frame):
    values = [(k, v) for k, vs in KNOWN.items() for v in vs]
    texts = [frame.format(v) for _, v in values]
    rows = {r.doc_id: r for r in pseudonyms.pseudonymised(table(spark, texts), "k").collect()}
    for i, (kind, value) in enumerate(values):
        found = {(f["kind"], f["value"]): f["pseudonym"] for f in rows[i].pii}
        assert (kind, value) in found, (texts[i], rows[i].pii)
        fake = found[kind, value]
        assert value not in rows[i].text and len(fake) == len(value) or kind == "ip"
        assert rows[i].text == texts[i].replace(value, fake) or len(found) > 1


def test_values_inside_a_very_long_text_and_equal_values_of_other_spelling(spark):
    long = "word " * 200_000
    texts = [long + "mail a.b@example.org " + long, "01.2.3.4 and 1.2.3.4", "a.b@example.org"]
    rows = {r.doc_id: r for r in pseudonyms.pseudonymised(table(spark, texts), "k").collect()}
    assert rows[0].pii[0]["pseudonym"] == rows[2].pii[0]["pseudonym"] and rows[0].text.startswith("word ")
    assert [f["value"] for f in rows[1].pii] == ["1.2.3.4"]


def test_clashing_columns_stay(spark):
    names = ["_found", "pii_found", "PII_TYPED", "_mix_key", "mix_key", "Mix_Key_", "_bad", "item_doc"]
    texts = ["call (212) 555-1234 today", "one two three four five six seven", None]
    df = table(spark, texts).select("doc_id", "text", "source", *[F.lit(n).alias(n) for n in names])
    bench = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    for out in (pseudonyms.pseudonymised(df, "k").drop("pii"), mixing.mix(df), decontaminate.without_items(df, bench)):
        assert out.columns == df.columns and {tuple(r)[3:] for r in out.collect()} == {tuple(names)}


def test_sql_and_search_agree_on_items_of_all_sizes(spark):
    """Items of 1 to 90 words, whole, cut to 80 % and below, inside texts of all lengths."""
    words = [f"w{i}" for i in range(400)]
    sizes = [1, 2, 3, 4, 5, 6, 9, 14, 20, 40, 85, 90]
    items = [(i, " ".join(words[i * 7 : i * 7 + n])) for i, n in enumerate(sizes)]
    texts = []
    for i, text in items:
        w = text.split()
        for share in (1.0, 0.9, 0.8, 0.7):
            keep = w[: max(1, round(len(w) * share))]
            texts.append(" ".join([*[f"a{i}x{j}" for j in range(i * 30)], *keep, *[f"b{i}x{j}" for j in range(5)]]))
    docs = table(spark, [*texts, "", None, "w0", "W7 w8"])
    bench = spark.createDataFrame([*items, (90, ""), (91, None), (None, "w0")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in decontaminate.contaminated(docs, bench, short=True).collect())
    con = duckdb.connect()
    documents, benchmark = docs.select("doc_id", "text").toPandas(), bench.where("item_id IS NOT NULL").toPandas()
    con.register("documents", documents)
    con.register("benchmark", benchmark)
    want = sorted(r[:4] for r in con.sql(f"SELECT doc_id, item_id, n_shingles, n_shared FROM ({decontaminate.SQL10})").fetchall())
    assert got == want and len({x[1] for x in got}) == len(sizes)


def test_each_size_class_has_its_own_sketch(spark):
    bench = spark.createDataFrame([(i, " ".join(f"i{i}w{j}" for j in range(n))) for i, n in enumerate([3, 8, 20, 60, 200])], "item_id long, text string")
    rows = {r.item_id: r for r in decontaminate.item_sketches(bench).collect()}
    assert [rows[i]["class"] for i in range(5)] == [0, 2, 4, 5, 7]
    assert [len(rows[i].minima) for i in range(5)] == [1, 1, 4, 12, 16] and [rows[i].need for i in range(5)] == [1, 1, 1, 1, 3]


def test_pipeline_of_awkward_and_empty_tables(spark, root, tmp_path):
    given = spark.read.parquet(f"{root}/documents.parquet")
    long = " ".join(f"w{i % 5000}" for i in range(40_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (None, "text without an id here", None, "b", 5), (4, "same words here again now", "en", "a", 5)]
    rows += [(4, "same words here again now", "en", "a", 5), (5, "same words here again now", "en", None, 5), (6, long, "en", "a", 5), (7, long + " end", "en", "a", 5), (8, "one", "en", "a", 5)]
    odd = spark.createDataFrame(rows, given.schema)
    for name, docs, keep in (("odd", odd, True), ("empty", given.limit(0), False)):
        folder = tmp_path / name
        docs.write.parquet(str(folder / "documents.parquet"))
        for other in ("labels", "benchmark"):
            df = spark.read.parquet(f"{root}/{other}.parquet")
            (df if keep else df.limit(0)).write.parquet(str(folder / f"{other}.parquet"))
        out = sorted(map(tuple, corpus_pipeline.run(spark, str(folder)).collect()), key=repr)
        assert (len(out) > 0) == keep
        if keep:
            ids = {r[0] for r in out}
            assert ids == {1, 2, 3, None, 4, 6, 8}  # of the groups {4, 5} and {6, 7} the first stays
