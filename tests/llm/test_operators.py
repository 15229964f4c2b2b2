"""Each operator against brute force on small tables, and on awkward rows."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from freightlens.llm import bilinear_lm, cover_search, decontaminate, licenses, minhash_dedup, mixing, pseudonyms, suffix_dedup, token_file, toxicity, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rep string, key string, u long"


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def table(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a"] * len(texts))[i], len(t or ""), "x", "y", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def some(spark, root):
    return spark.read.parquet(f"{root}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, repeated rows, a very long text, clashing columns."""
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [
        (1, None, None, None, None, None, None, None),
        (2, "", "en", "a", 0, "x", "y", 1),
        (3, " \n\t ", "en", "a", 4, "x", "y", 1),
        (None, "text without an id here", None, "b", 5, None, None, None),
        (4, "same words here again now", "en", "a", 5, "x", "y", 1),
        (4, "same words here again now", "en", "a", 5, "x", "y", 1),
        (5, "same words here again now", "en", None, 5, "x", "y", 1),
        (6, long, "en", "a", 5, "x", "y", 1),
        (7, long + " end", "en", "a", 5, "x", "y", 1),
        (8, "one", "en", "a", 5, "x", "y", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


def shingle_set(text, k):
    w = word_list(text)
    return frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, percent=80):
    sets = {i: shingle_set(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(n=60):
    """A star of near copies whose members are often less alike than 0.8, and a chain."""
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(80)]
    texts = []
    for i in range(n):
        w = list(base)
        for at in rng.choice(80, rng.integers(0, 9), replace=False):
            w[at] = f"n{i}x{at}"
        texts.append(" ".join(w))
    chain = [f"c{i}" for i in range(100)]
    texts += [" ".join(chain[i * 4 : i * 4 + 60]) for i in range(9)]
    return texts


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicate_groups(spark, k):
    texts = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.groups(table(spark, texts), minhash_dedup.Settings(k=k)).collect()}
    assert got == brute_components(list(enumerate(texts)), k)


def test_estimate_loses_less_than_the_banding():
    """A pair at 0.8 must not fail the estimate more often than a hundredth of what shares no band."""
    cfg = minhash_dedup.Settings()
    n, p = cfg.bands * cfg.rows, cfg.percent / 100
    least = math.ceil(cfg.estimate * n)
    fails = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(least))
    assert fails < (1 - p**cfg.rows) ** cfg.bands / 100


def test_near_duplicates_of_the_tables(some):
    rows = [(r.doc_id, r.text) for r in some.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.groups(some, minhash_dedup.Settings(k=2)).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute_components(rows, 2).items()}


def test_near_duplicates_of_odd_rows(odd):
    rows = minhash_dedup.groups(odd).collect()
    assert len(rows) == 10
    by = {r.doc_id: r for r in rows}
    assert (by[1].n_shingles, by[1].component_id, by[2].component_id, by[3].n_shingles) == (0, 1, 2, 0)
    assert by[None].component_id is None and not by[None].kept
    assert by[5].component_id == 4 and by[7].component_id == 6 and by[8].component_id == 8
    kept = minhash_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 8]
    assert minhash_dedup.groups(odd.limit(0)).collect() == []


def test_segments_are_maximal():
    rng = np.random.default_rng(0)

    def brute(s, lo=0):
        best, at = 0.0, None
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                t = s[a:b].sum()
                if t > best + 1e-9 or (at and abs(t - best) <= 1e-9 and b - a < at[1] - at[0] and False):
                    best, at = t, (a, b)
        if at is None:
            return []
        a, b = at
        return brute(s[:a], lo) + [(lo + a, lo + b)] + brute(s[b:], lo + b)

    for _ in range(60):
        s = rng.normal(-0.2, 1, rng.integers(1, 14))
        assert [(a, b) for a, b, _ in toxicity.segments(s)] == brute(s)


def test_toxicity_catches_held_out_passages(spark):
    rng = np.random.default_rng(1)
    clean, bad = [f"plain{i}" for i in range(300)], [f"venom{i}" for i in range(12)]
    texts, labels = [], []
    for i in range(600):
        w = list(rng.choice(clean, 60))
        toxic = i % 6 == 0
        if toxic:
            w[20:28] = rng.choice(bad, 8)
        texts.append(" ".join(w))
        labels.append((i, 1, int(toxic)))
    docs = table(spark, texts)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, known)).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum(got[i].predicted == int(i % 6 == 0) for i in held)
    assert right >= 0.98 * len(held)
    hit = next(got[i] for i in held if i % 6 == 0)
    found = texts[hit.doc_id].encode()[hit.passages[0].start : hit.passages[0].stop].decode()
    assert "venom" in found


def test_toxicity_of_odd_rows(spark, odd):
    known = spark.createDataFrame([(4, 1, 0), (6, None, None), (None, 1, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(odd, toxicity.fit(odd, known)).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.keep_clean(odd, known).columns == odd.columns
    assert toxicity.keep_clean(odd.limit(0), known.limit(0)).count() == 0


def test_pseudonyms_are_valid_linked_and_reversible(spark):
    texts = [
        "pay 4539 1488 0343 6467 and 4539148803436467, not 4539148803436468",
        "from 10.20.30.40 to 255.255.255.255 but 300.1.1.1 on 2024-02-29 not 2024-02-30",
        "ssn 123-45-6789 not 000-12-3456 call +1 (555) 123-4567 or ab.c9@mail.example.com",
        "again 10.20.30.40 and ab.c9@mail.example.com",
        None,
        "",
    ]
    rows = {r.doc_id: r for r in pseudonyms.pseudonymised(table(spark, texts), "k").collect()}
    pairs = {f.value: (f.kind, f.pseudonym) for r in rows.values() for f in r.pii}
    assert {v: k for v, (k, _) in pairs.items()} == {
        "4539 1488 0343 6467": "card", "4539148803436467": "card", "10.20.30.40": "ip", "255.255.255.255": "ip", "2024-02-29": "date",
        "123-45-6789": "ssn", "+1 (555) 123-4567": "phone", "ab.c9@mail.example.com": "email",
    }
    assert pairs["4539 1488 0343 6467"][1].replace(" ", "") == pairs["4539148803436467"][1]
    for value, (kind, new) in pairs.items():
        assert new != value and re.sub("[a-z]", "a", re.sub(r"\d", "9", new)).count("9") > 0
        if kind in ("card", "ssn", "phone", "email", "date"):
            assert re.sub("[a-z]", "a", re.sub(r"\d", "9", new)) == re.sub("[a-z]", "a", re.sub(r"\d", "9", value))
    assert "300.1.1.1" in rows[1].text and "2024-02-30" in rows[1].text and "000-12-3456" in rows[2].text
    assert rows[4].text is None and rows[5].text == "" and rows[4].pii == []
    again = {f.pseudonym: (f.kind, f.pseudonym) for r in rows.values() for f in r.pii}
    back = spark.createDataFrame([(k, p, v) for v, (k, p) in pairs.items()], "kind string, p string, v string")
    assert again and all(r.x == r.v for r in back.select("v", pseudonyms.pseudonym(F.col("p"), F.col("kind"), "k", back=True).alias("x")).collect())


def test_pseudonyms_permute(spark):
    n = 899 * 3
    got = spark.range(n).select(pseudonyms.permuted(F.col("id"), 899, 3, "k", "t").alias("x")).collect()
    assert sorted(r.x for r in got) == list(range(n))


def test_pseudonyms_of_odd_rows(odd):
    out = pseudonyms.pseudonymised(odd, "k")
    assert out.count() == 10 and out.where("size(pii) > 0").count() == 0
    assert [r.text for r in out.orderBy("doc_id", "text").collect()] == [r.text for r in odd.orderBy("doc_id", "text").collect()]


@pytest.mark.parametrize("width", [1, 5, 8, 11, 16, 17, 32])
def test_packing_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 2 ** min(width, 31), 70_001)
    payload = token_file.pack(ids, width)
    assert len(payload) == (len(ids) * width + 7) // 8
    assert (token_file.unpack(payload, width, 0, len(ids)) == ids).all()
    for a, b in ((3, 3), (5, 6), (65_530, 65_600), (70_000, 70_001)):
        assert (token_file.unpack(payload, width, a, b) == ids[a:b]).all()


def token_rows(rows):
    from tokenizers import Tokenizer

    tok, out, start = Tokenizer.from_str(token_file.tokenizer_file()), [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_file_of_the_tables(some):
    got = token_file.encoded(some, token_file.tokenizer_file()).collect()
    assert sorted(map(tuple, got)) == sorted(token_rows([(r.doc_id, r.text) for r in some.collect()]))


def test_token_file_of_odd_rows(odd):
    got = [tuple(r) for r in token_file.encoded(odd, token_file.tokenizer_file()).collect()]
    want = token_rows([(r.doc_id, r.text) for r in odd.collect()])
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_file.encoded(odd.limit(0), token_file.tokenizer_file()).count() == 0


def test_piece_encoding_of_hard_texts():
    from tokenizers import Tokenizer

    rng = np.random.default_rng(3)
    parts = ["a", "The", "é", "ß", ",", ".", " ", "  ", "\n", "\t", "\r\n", " ", "　", "1", "'s", "<|endoftext|>", "“", "?;", "日本", "\x85", "\U0001f600"]
    text = token_file.tokenizer_file()
    tok, enc = Tokenizer.from_str(text), token_file.PieceEncoder(text)
    for _ in range(400):
        texts = ["".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(3)]
        data = [t.encode() for t in texts]
        ids, sizes = enc.encode(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]))
        for t, end, n in zip(texts, np.cumsum(sizes), sizes):
            assert ids[end - n : end].tolist() == tok.encode(t, add_special_tokens=False).ids


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(-6, 7, (700, 6))
    v[10:30] = v[5]  # ties
    data = spark.createDataFrame([(i, [int(x) for x in row]) for i, row in enumerate(v)], "vec_id long, v array<long>")
    cfg = cover_search.Settings(k=7, queries=20, candidates=150)
    got = {}
    for r in cover_search.top_k(data.where("vec_id % 10 = 0"), data, cfg).collect():
        got[r.query_id, r.rank] = (r.vec_id, r.score)
    s = v @ v.T
    for q in range(0, 700, 10):
        order = sorted((x for x in range(700) if x != q), key=lambda x: (-s[q, x], x))[:7]
        assert [got[q, i + 1] for i in range(7)] == [(x, s[q, x]) for x in order]


def test_dual_trees_prune_clustered_vectors():
    rng = np.random.default_rng(1)
    middles = rng.normal(0, 1, (40, 16))
    middles *= 600 / np.linalg.norm(middles, axis=1, keepdims=True)
    c = np.floor(middles[rng.integers(0, 40, 12_000)] + rng.normal(0, 8, (12_000, 16)))
    q = c[::10]
    search = cover_search.Search(q, np.arange(0, 12_000, 10), c, np.arange(12_000), 20)
    score, ids = search.run()
    s = q @ c.T
    s[np.arange(len(q)), np.arange(0, 12_000, 10)] = -np.inf
    assert np.array_equal(score, -np.sort(-s, axis=1)[:, :20])
    assert search.compared < 0.2 * len(q) * len(c)


def test_trees_cover_their_points():
    rng = np.random.default_rng(2)
    for x in (rng.integers(-50, 50, (3000, 6)).astype(float), np.repeat(rng.integers(-5, 5, (3, 4)), 700, 0).astype(float), np.zeros((900, 3))):
        stack, held = [cover_search.cover_tree(x, np.arange(len(x)))], []
        while stack:
            node = stack.pop()
            assert np.linalg.norm(x[node.rows] - node.center, axis=1).max() <= node.radius + 1e-9
            if node.children:
                assert sorted(r for n in node.children for r in n.rows) == sorted(node.rows)
            else:
                held += node.rows.tolist()
            stack += node.children
        assert sorted(held) == list(range(len(x)))


def test_vectors_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, None), (40, [nan, 1.0]), (60, [inf, 1.0]), (80, [None, 1.0]), (None, [1.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, []), (100, [0.5, -0.01])]
    v = cover_search.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = sorted(map(tuple, cover_search.top_k(v.where("vec_id % 20 = 0"), v).collect()))
    assert got == [(0, 1, 1, 12288), (0, 2, 100, 1920), (100, 1, 1, 1984), (100, 2, 0, 1920)]
    assert cover_search.top_k(v.limit(0), v).count() == 0


def test_language_model_counts_and_gain(some):
    rows = [(r.doc_id, r.text) for r in some.collect()]
    toks = {i: word_list(t) + [0] for i, t in rows}
    held = {i for i in toks if zlib.crc32(str(i).encode()) % 7 == 2}
    c = Counter(x for i, w in toks.items() if i not in held for x in w)
    n, v = sum(c.values()), len(c)
    cfg = bilinear_lm.Settings(kept=500)
    model, counts = bilinear_lm.fit(some.where(F.crc32(F.col("doc_id").cast("string")) % 7 != 2), cfg)
    got = bilinear_lm.score(some, model, counts, cfg).collect()
    assert len(got) == len(rows)
    for r in got:
        w = toks[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    assert sum(r.score for r in got if r.doc_id in held) > sum(r.base_score for r in got if r.doc_id in held)
    # units of every context sum to one
    total = np.exp(model.one[:, None, :] + model.two[None, :, :] + model.bias - model.norm[:, :, None]).sum(2)
    assert np.allclose(total, 1, atol=1e-3)


def test_language_model_of_odd_rows(odd):
    cfg = bilinear_lm.Settings(rounds=1)
    model, counts = bilinear_lm.fit(odd, cfg)
    rows = bilinear_lm.score(odd, model, counts, cfg).collect()
    assert len(rows) == 10 and all(r.n_tokens == r.n_known and r.score < 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    model, counts = bilinear_lm.fit(odd.limit(0), cfg)
    assert all(r.n_known == 0 and math.isfinite(r.score) for r in bilinear_lm.score(odd, model, counts, cfg).collect())


def test_mixing_meets_targets(spark):
    sources = ["big"] * 300 + ["mid"] * 60 + [None] * 12
    docs = table(spark, [f"w{i} " * (1 + i % 7) for i in range(372)], sources)
    own = Counter()
    for i, s in enumerate(sources):
        own[s or ""] += 1 + i % 7
    rows = mixing.plan(docs, repetition=3.0, block_tokens=200).collect()
    assert {r.doc_id for r in rows} == set(range(372))
    got = Counter()
    for r in rows:
        got[r.source] += r.n_tokens
    rate = {s: got[s] / own[s] for s in own}
    assert max(rate.values()) / min(rate.values()) <= 3.0 + 0.5 and max(rate.values()) > 2.5 and min(rate.values()) == 1
    assert len({(r.block, r.place) for r in rows}) == len(rows)
    per_block = Counter(r.block for r in rows for _ in range(r.n_tokens))
    assert max(per_block.values()) <= 200 + 3 * 7 and set(per_block) == set(range(len(per_block)))
    for r in mixing.plan(docs, repetition=None, budget=400).collect():
        assert math.isclose(r.weight, own[r.source] / sum(own.values()), rel_tol=1e-9)
    flat = mixing.plan(docs, entropy=math.log(3) * 0.95, repetition=None, budget=2000).select("source", "weight").distinct().collect()
    assert abs(-sum(r.weight * math.log(r.weight) for r in flat) - math.log(3) * 0.95) < 1e-4


def test_mixing_of_odd_rows(odd):
    out = mixing.mix(odd, repetition=1.0)
    assert out.columns == odd.columns and out.count() == 10
    assert mixing.mix(odd.limit(0)).count() == 0


def brute_repeats(rows, least):
    seen = {}
    toks = {i: word_list(t) for i, t in rows}
    for i, w in toks.items():
        for a in range(len(w) - least + 1):
            seen.setdefault(tuple(w[a : a + least]), set()).add(i)
    cover = {}
    for i, w in toks.items():
        at = {p for a in range(len(w) - least + 1) if len(seen[tuple(w[a : a + least])]) > 1 for p in range(a, a + least)}
        if at:
            cover[i] = len(at)
    return cover


def test_planted_passages_are_found(spark):
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(51)]
    texts = []
    for i in range(40):
        w = [f"d{i}w{j}" for j in range(rng.integers(20, 200))]
        if i % 4 == 0:
            at = rng.integers(0, len(w))
            w[at:at] = passage
        texts.append(" ".join(w))
    got = {r.doc_id: r for r in suffix_dedup.repeats(table(spark, texts)).collect()}
    assert {i: r.n_repeated for i, r in got.items()} == brute_repeats(list(enumerate(texts)), 50) == {i: 51 for i in range(0, 40, 4)}
    (first,) = [i for i, r in got.items() if r.n_later == 0]
    other = 4 if first != 4 else 8
    cut = {r.doc_id: r.text for r in suffix_dedup.without_repeats(table(spark, texts)).collect()}
    assert cut[first] == texts[first] and word_list(cut[other]) == [w for w in word_list(texts[other]) if not w.startswith("p")]


def test_repeats_of_the_tables(some):
    got = {r.doc_id: r.n_repeated for r in suffix_dedup.repeats(some).collect()}
    want = brute_repeats([(r.doc_id, r.text) for r in some.collect()], 50)
    assert got == want


def test_repeats_of_odd_rows(odd):
    rows = suffix_dedup.repeats(odd).collect()
    assert sorted(r.doc_id for r in rows) == [6, 7]
    assert suffix_dedup.without_repeats(odd).count() == 10 and suffix_dedup.repeats(odd.limit(0)).count() == 0


def test_repeats_of_crowded_passages(spark):
    """A shared passage held 3000 times by two documents, contexts that differ on one side, and later copies of one passage."""
    shared = [f"s{i}" for i in range(40)]
    texts = [" ".join([f"a{i}x{j}" for j in range(30)] + ["line"] * 3000) for i in range(2)]
    # the neighbour holds the start of a passage before it holds the passage
    whole = [f"p{i}" for i in range(60)]
    texts += [" ".join([*whole[:45], *[f"n{j}" for j in range(20)], *whole]), " ".join([*[f"m{j}" for j in range(20)], *whole])]
    # equal words on the left of the stem, and equal words on its right, by pairs
    for i in range(12):
        texts.append(" ".join([*[f"l{i // 2}y{j}" for j in range(12)], *shared, *[f"r{(i + 1) // 2}y{j}" for j in range(12)]]))
    texts += [" ".join([*[f"e{i}z{j}" for j in range(20)], *[f"c{j}" for j in range(70)]]) for i in range(20)]
    docs = table(spark, texts)
    got = {r.doc_id: r for r in suffix_dedup.repeats(docs).collect()}
    assert {i: r.n_repeated for i, r in got.items()} == brute_repeats(list(enumerate(texts)), 50)
    copies = range(len(texts) - 20, len(texts))
    assert sorted(got[i].n_later for i in copies) == [0] + [70] * 19
    assert sorted(got[i].n_later > 0 for i in (0, 1)) == [False, True]


@pytest.mark.parametrize("turn", range(6))
def test_a_passage_in_a_crowd_of_near_ones(spark, turn):
    """Two documents share 50 words; 24 more share its stem and one side with either, 45 words in all."""
    left, stem, right = ([f"{c}{i}" for i in range(n)] for c, n in (("l", 7), ("s", 35), ("r", 8)))
    other = lambda c, i, n: [f"{c}{i}o{j}" for j in range(n)]
    texts = [" ".join([*other("x", i, 30), *left, *stem, *right, *other("y", i, 30)]) for i in range(2)]
    for i in range(24):
        a, b = (left[-2:], other("q", i, 8)) if i % 2 else (other("p", i, 7), right)
        texts.append(" ".join([*other("u", i, 20), *a, *stem, *b, *other("v", i, 20)]))
    order = np.random.default_rng(turn).permutation(len(texts))
    texts = [texts[i] for i in order]
    got = {r.doc_id: r.n_repeated for r in suffix_dedup.repeats(table(spark, texts)).collect()}
    assert got == brute_repeats(list(enumerate(texts)), 50) and len(got) == 2


def test_originals_and_copies(spark):
    """Of equal texts and of texts that share a passage, exactly one holds the original of each word."""
    whole, more = [f"p{i}" for i in range(60)], [f"q{i}" for i in range(70)]
    texts = [" ".join(whole)] * 3 + [" ".join([*more, *whole])] * 2 + [" ".join(more[:55])]
    got = {r.doc_id: r for r in suffix_dedup.repeats(table(spark, texts)).collect()}
    assert {i: r.n_repeated for i, r in got.items()} == {0: 60, 1: 60, 2: 60, 3: 130, 4: 130, 5: 55}
    words_kept = sum(r.n_repeated - r.n_later for r in got.values())
    assert words_kept >= 130 and sum(r.n_later == 0 for r in got.values()) >= 1
    cut = Counter(w for r in suffix_dedup.without_repeats(table(spark, texts)).collect() for w in word_list(r.text))
    assert all(cut[w] >= 1 for w in [*whole, *more]) and max(cut.values()) == 1


def test_passages_keep_clashing_columns(spark):
    texts = [" ".join([*[f"p{i}" for i in range(60)], f"e{k}"]) for k in range(3)]
    names = ["passage_key", "passage_cuts", "PASSAGE_KEY_", "_later", "_key", "unit", "lo"]
    df = table(spark, texts).select("doc_id", "text", *[F.lit(n).alias(n) for n in names])
    out = suffix_dedup.without_repeats(df)
    assert out.columns == df.columns
    assert {tuple(r)[2:] for r in out.collect()} == {tuple(names)}


def test_license_notices(spark):
    apache = licenses.TEMPLATES["Apache-2.0-header"]
    texts = [
        "intro words " + apache + " more words",
        "x " + apache.replace("except in compliance", "save in full compliance") + " y",
        "Released under the MIT License.",
        "under the terms of the license, version of the software",
        "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0",
        None,
        "",
    ]
    got = sorted((r.doc_id, r.license) for r in licenses.scan(table(spark, texts)).collect())
    assert got == [(0, "Apache-2.0-header"), (1, "Apache-2.0-header"), (2, "MIT"), (4, "Apache-2.0"), (4, "CC-BY-NC-4.0")]
    r = licenses.scan(table(spark, texts)).where("doc_id = 2").first()
    assert (texts[2][r.start : r.stop], r.coverage) == ("Released under the MIT License", 1.0)


def test_licenses_of_odd_rows(odd):
    assert licenses.scan(odd).count() == 0 and licenses.scan(odd.limit(0)).count() == 0


def test_alignment_matches_plain_dynamic_programming():
    rng = np.random.default_rng(8)
    for _ in range(30):
        a, b = rng.integers(0, 4, 12), rng.integers(0, 4, 9)
        s = np.zeros((10, 13))
        for i in range(1, 10):
            for j in range(1, 13):
                s[i, j] = max(0, s[i - 1, j - 1] + (2 if a[j - 1] == b[i - 1] else -1), s[i - 1, j] - 1, s[i, j - 1] - 1)
        m, start, stop = licenses.align(a, b, 0, 20)
        assert 2 * m >= s.max() and (s.max() == 0 or stop > start)


def test_contained_items(spark):
    rng = np.random.default_rng(9)
    items = [" ".join(f"q{i}w{j}" for j in range(n)) for i, n in enumerate((3, 5, 12, 40, 90))]
    texts = []
    for i in range(30):
        w = [f"d{i}x{j}" for j in range(rng.integers(50, 3000))]
        q = word_list(items[i % 5])
        if i < 10:
            q[len(q) // 2 : len(q) // 2 + (1 if i >= 5 and len(q) > 30 else 0)] = []
            w[7:7] = q
        texts.append(" ".join(w))
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, ""), (None, "a b c d e f")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_shingles) for r in decontaminate.contaminated(table(spark, texts), bench).collect()}
    want = {}
    for i, t in enumerate(texts):
        for q, x in enumerate(items):
            a, b = shingle_set(x, 5), shingle_set(t, 5)
            if len(a & b) * 100 >= len(a) * 80:
                want[i, q] = (len(a & b), len(a))
    assert got == want and len(want) >= 8


def test_contained_items_of_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "same words here again now"), (1, "one"), (2, "other words")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, bench).collect()} == {(4, 1), (5, 1), (8, 1)}
    kept = decontaminate.without_items(odd, bench)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 6, 7]
    assert decontaminate.without_items(odd, bench.limit(0)).count() == 10
    assert decontaminate.without_items(odd.limit(0), bench).count() == 0


def test_short_items_inside_long_documents(spark):
    items = ["one", "two words", "three words here", "now four words here", "five words are a shingle"]
    filler = " ".join(f"f{i}" for i in range(300))
    texts = [f"{filler} {x} {filler}" for x in items] + [filler, "two other words", None, "One"]
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    want = {(d, q) for d, t in enumerate(texts) for q, x in enumerate(items) if f" {x} " in f" {(t or '').lower()} "}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table(spark, texts), bench, short=True).collect()} == want
    assert sorted(r.doc_id for r in decontaminate.without_items(table(spark, texts), bench).collect()) == [5, 6, 7]


def test_words_match_a_regular_expression():
    rng = np.random.default_rng(1)
    parts = ["A", "bc", "é", " ", "\n", "\t\x0b", " ", ".", "Zz"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(300)]
    data = [t.encode() for t in texts]
    raw = np.frombuffer(b"".join(data), np.uint8)
    found = words.Words(raw, np.concatenate([[0], np.cumsum([len(x) for x in data])]))
    seen = {}
    for i, t in enumerate(texts):
        a, b = found.first[i], found.first[i + 1]
        w = word_list(t)
        assert [re.sub(b"[A-Z]", lambda m: m.group().lower(), raw[s:e].tobytes()).decode() for s, e in zip(found.start[a:b], found.end[a:b])] == w
        for x, h in zip(w, found.hash[a:b].tolist()):
            assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)
