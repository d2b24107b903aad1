"""Spelling variants, exact dedup and ranked search against brute force, and their edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pitchflow.llm import exact_dedup, line_dedup, ngram_join, pairs, queries, ranked_search, spelling
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], DOC)


CLASHING = ["word", "n", "id", "v", "h", "key", "row", "digest", "bucket", "kept", "shard", "term", "df", "block", "rank", "score", "item_id", "places", "form", "root", "member", "named"]


def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing columns."""
    long = "wordthing another thinghere " * 20_000
    texts = [None, "", " \n\n ", "one", "wordthing wordthing", "wordthing wordthing", long, "x\ty\x0bz\x0c q\r\n w", "漢字" * 50, "wordthing wordthing", "z" * 9000, "z" * 8999 + "y"]
    d = docs(spark, texts, [0, 1, 2, 3, 4, 5, 6, 7, 8, 4, 10, 11]).withColumns({c: F.lit(1) for c in CLASHING})
    return d.unionByName(d.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(d.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))


def empty(spark):
    return docs(spark, []).withColumns({c: F.lit(1) for c in CLASHING})


# spelling variants


def slow_words(rows):
    total = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 2}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def slow_variants(total):
    """Candidates by the deletion of each character, then a check of each pair."""
    seen = collections.defaultdict(set)
    for w in total:
        for k in range(len(w)):
            seen[w[:k] + w[k + 1 :]].add(w)
        seen[w].add(w)
    near = {w: set() for w in total}
    for group in seen.values():
        for a in group:
            near[a] |= {b for b in group if b not in near[a] and is_near(a, b)}
    form = {}
    for w, all_ in near.items():
        best = min(all_, key=lambda x: (-total[x], x), default=None)
        form[w] = best if best is not None and total[best] >= 10 * total[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, n, len(near[w]), form[w], total[form[w]] if form[w] else None, root(w)) for w, n in total.items()}


def rows_of(df):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_spelling_variants(spark, sf):
    """The query on its whole table."""
    got = queries.op11_spelling_variants(spark, sf)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = slow_variants(slow_words(rows))
    found = got.collect()
    assert len(found) == len(want) and rows_of(got) == want
    assert sum(r.form is not None for r in found) > 5 and any(r.n_near > 1 for r in found)


def test_spelling_dense_words(spark):
    """Few letters, so that words have many near ones of each kind; chains of forms."""
    r = random.Random(3)
    text = [" ".join("".join(r.choice("abé") for _ in range(r.randint(6, 9))) for _ in range(3000)) for _ in range(2)]
    text.append("aaaaaaa " * 5000 + "aaaaaab " * 400 + "aaaaabb " * 30 + "aaaabbb " * 2)
    rows = list(enumerate(text))
    got = rows_of(spelling.variants(docs(spark, text)))
    assert got == slow_variants(slow_words(rows))
    assert any(x[3] and x[5] != x[3] for x in got)


def test_spelling_edges(spark):
    assert spelling.variants(empty(spark)).count() == 0
    d = awkward(spark)
    got = rows_of(spelling.variants(d))
    assert got == slow_variants(slow_words([(r.doc_id, r.text) for r in d.collect()]))
    # two runs of 9,000 letters that differ in the last one, twice each
    twice = spelling.variants(docs(spark, ["z" * 8000 + " " + "z" * 7999 + "y"] * 2), errors=False)
    assert sorted((len(x[0]), x[1], x[2]) for x in rows_of(twice)) == [(8000, 2, 1), (8000, 2, 1)]


# exact dedup


def test_perfect_hash():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 20_000):
        d = r.integers(0, 256, (n, 32), np.uint8)
        built = exact_dedup.PerfectHash.build(d)
        again = exact_dedup.PerfectHash(built.sizes, built.packed())
        assert sorted(again.slots(d).tolist()) == list(range(n))
        other = again.slots(r.integers(0, 256, (100, 32), np.uint8))
        assert (other >= -1).all() and (other < max(n, 1)).all()
    with pytest.raises(ValueError, match="distinct"):
        exact_dedup.PerfectHash.build(np.zeros((2, 32), np.uint8))


def test_exact_dedup_equals_sql(check_sql):
    check_sql(queries.op12_exact_dedup, queries.ORACLE_SQL["op12_exact_dedup"])
    check_sql(queries.op12_exact_dedup, queries.ORACLE_SQL["op12_exact_dedup"], "/root/testdata/sf0.01")


@pytest.mark.parametrize("per", [3, 100_000])
def test_exact_dedup_edges(spark, monkeypatch, per):
    monkeypatch.setattr(exact_dedup, "BUCKET", per)
    assert exact_dedup.dedup(empty(spark)).count() == 0
    d = awkward(spark)
    out = exact_dedup.dedup(d).collect()
    size, kept = collections.Counter(r.text or "" for r in d.collect()), collections.defaultdict(list)
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in size}
    assert len(out) == d.count()
    for r in out:
        t = sha[r.text_sha256]
        assert r.group_size == size[t]
        named = [x.doc_id for x in d.collect() if (x.text or "") == t and x.doc_id is not None]
        assert r.keep_id == max(named, default=None)
        if r.kept:
            assert r.doc_id == r.keep_id
            kept[t].append(r)
    assert {t: len(x) for t, x in kept.items()} == dict.fromkeys(size, 1)
    alone = exact_dedup.dedup(docs(spark, ["a", "a", None], [None, None, None])).collect()
    assert sorted((r.keep_id is None, r.group_size, r.kept) for r in alone) == [(True, 1, True), (True, 2, False), (True, 2, True)]


def test_exact_dedup_batches(spark):
    """An index that took in one batch after the other is that of all of them."""
    r = random.Random(4)
    texts = [f"t{r.randrange(60)}" for _ in range(400)]
    rows = exact_dedup.located(docs(spark, texts)).cache()
    parts = [exact_dedup.groups(rows.where(F.pmod("doc_id", F.lit(3)) == k)) for k in range(3)]
    index = exact_dedup.build(parts[0], 4)
    for p in parts[1:]:
        index = exact_dedup.absorb(index, p, 4)
    after = {(bytes(x.digest), x.id, x.n) for x in exact_dedup.look_up(index, exact_dedup.groups(rows.limit(0)), 4).collect()}
    assert after == {(bytes(x.digest), x.id, x.n) for x in exact_dedup.groups(rows).collect()}


# ranked search


def slow_search(rows, items, k=20):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    tf = [(i, collections.Counter(split(t))) for i, t in rows]
    n, all_ = sum(bool(c) for _, c in tf), sum(sum(c.values()) for _, c in tf)
    df = collections.Counter(t for _, c in tf for t in c)
    out = {}
    for item, text in items:
        asked, found = collections.Counter(split(text)), []
        for i, c in tf:
            score = 0
            for t, times in asked.items():
                if c[t]:
                    m = 100 - 25 + (25 * sum(c.values()) * n) // all_
                    score += times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((score, i))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out[item] = [(rank + 1, i, s) for rank, (s, i) in enumerate(found[:k])]
    return {i: x for i, x in out.items() if x}


def ranks(df):
    out = collections.defaultdict(list)
    for r in df.orderBy("item_id", "rank").collect():
        out[r.item_id].append((r["rank"], r.doc_id, r.score))
    return dict(out)


def test_search_equals_sql(check_sql):
    check_sql(queries.op13_ranked_search, queries.ORACLE_SQL["op13_ranked_search"], least=800)
    check_sql(queries.op13_ranked_search, queries.ORACLE_SQL["op13_ranked_search"], "/root/testdata/sf0.01", 800)


def test_packed_numbers():
    r = np.random.default_rng(2)
    v = np.concatenate([[0, 1, 127, 128, 16383, 16384, 2**40], r.integers(0, 1 << 30, 500)])
    data, ends = ranked_search.packed(v)
    assert ranked_search.unpacked(data.tobytes()).tolist() == v.tolist() and ends[-1] == len(data)
    assert ranked_search.unpacked(b"").tolist() == []


@pytest.mark.parametrize(("shard", "block"), [(40, 2), (4_000_000, 256)])
def test_search_shards_blocks_and_ties(spark, monkeypatch, shard, block):
    """Small shards and blocks, many ties, repeated terms and items of common terms alone."""
    r = random.Random(5)
    monkeypatch.setattr(ranked_search, "SHARD", shard)
    monkeypatch.setattr(ranked_search, "BLOCK", block)
    rows = [(i, " ".join(r.choice(["a", "B", "c", "é1", "x9", "İ"] + [f"w{k}" for k in range(30)]) for _ in range(r.randint(0, 30)))) for i in r.sample(range(1000), 300)]
    items = [(i, " ".join(r.choice(["a", "b", "é1", "w1", "w2", "W3", "none", "i"]) for _ in range(r.randint(0, 6)))) for i in range(12)]
    d = docs(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(3)
    got = ranks(ranked_search.rank_all(d, spark.createDataFrame(items, "item_id long, text string")))
    assert got == slow_search(rows, items)


def test_best_leaves_no_document_out():
    r = random.Random(6)
    for _ in range(300):
        lists = []
        for _ in range(r.randint(0, 6)):
            d = sorted(r.sample(range(60), r.randint(1, 50)))
            s = [r.choice([0, 1, 2, 5, 100]) for _ in d]
            lists.append((d, s, max(s)))
        total = collections.Counter()
        for d, s, _ in lists:
            for x, y in zip(d, s):
                total[x] += y
        want = sorted(((s, d) for d, s in total.items() if s), key=lambda x: (-x[0], x[1]))
        assert ranked_search.best(lists, 5) == want[:5]


def test_search_edges(spark):
    items = [(1, "wordthing one"), (2, None), (3, ""), (None, "one"), (4, "漢字"), (1, "one"), (5, "thinghere ?!")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in CLASHING if c != "item_id"})
    assert ranked_search.rank_all(empty(spark), asked).count() == 0
    d = awkward(spark)
    assert ranked_search.rank_all(d, asked.limit(0)).count() == 0
    merged = [(1, "wordthing one one"), (5, "thinghere")]
    got = ranks(ranked_search.rank_all(d, asked))
    assert got == slow_search([(r.doc_id, r.text) for r in d.drop("item_id").collect()], merged)


def test_boundary_counts_lists_that_stay(spark):
    """Sets of six n-grams may have partners of seven: they stay listed whatever six costs, and enumerating them saves nothing."""
    scheme = ngram_join.Scheme(85)
    sets = spark.createDataFrame([(6, i, [1]) for i in range(50)], "n_shingles long, node long, listed array<long>")
    lengths = spark.createDataFrame([(1, 50)], "key long, length long")
    assert ngram_join.boundary(scheme, sets, lengths) in (scheme.least - 1, 7)
    both = sets.unionByName(spark.createDataFrame([(7, 100 + i, [2]) for i in range(5000)], sets.schema))
    assert ngram_join.boundary(scheme, both, lengths) == scheme.least - 1


def test_lists_with_most_nodes_in_common_take_other_heads(spark):
    """Thirty lists of the same sixty nodes and one of their own: each turn holds them against many nodes, not all against one."""
    met = spark.createDataFrame([(k, i, 0) for k in range(30) for i in [*range(60), 100 + k]], "key long, node long, lo long")
    feats = met.select("node").distinct().selectExpr("node", "10L n", "array(0L) bits")
    heads = []

    def verify(found):
        rows = found.collect()
        heads.append({r.a for r in rows})
        links = [(r.a, r.b) for r in rows if r.a % 3 == r.b % 3]
        return spark.createDataFrame(links, "a long, b long")

    got = {r.node: r.root for r in pairs.linked(met, feats, verify, 85, 1).collect()}
    assert got == {i: i % 3 for i in [*range(60), *range(100, 130)] if i > 2}
    assert len(heads[1]) > 5


def test_pairs_with_the_most_copied_are_checked_once(spark):
    """Lists of two whose one pair does not link, and a large list: what was held against its most copied node is not checked again."""
    met = spark.createDataFrame([(k, 10 * k + i, 10 * k) for k in range(5) for i in (0, 1)] + [(9, i, 100) for i in range(100, 112)], "key long, node long, lo long")
    feats = met.select("node").distinct().selectExpr("node", "10L n", "array(0L) bits")
    seen = []

    def verify(found):
        rows = [tuple(sorted(x)) for x in found.collect()]
        seen.extend(rows)
        return spark.createDataFrame([x for x in rows if x[0] >= 100 and x[0] % 4 == x[1] % 4], "a long, b long")

    got = {r.node: r.root for r in pairs.linked(met, feats, verify, 80, 1).collect()}
    assert got == {i: 100 + i % 4 for i in range(104, 112)}
    heads = [x for x in seen if x[0] % 10 == 0 and x[0] <= 100]
    assert len(heads) == len(set(heads)) == 16 and {(10 * k, 10 * k + 1) for k in range(5)} <= set(seen)


def test_similar_lines_without_a_row_a_run(spark):
    """Sets made where the pair lies and runs as rows give the same pairs, those of brute force."""
    r = random.Random(3)
    lines = ["".join(r.choices("abcdef gh", k=n)) for n in (1, 7, 9, 40, 300, 900)] + ["=" * 50, "=" * 90, "na " * 60, "\u00e4\U0001f600" * 20]
    lines += [x[:-1] for x in lines if len(x) > 20] + [x[: len(x) // 2] for x in lines]
    texts = spark.createDataFrame(list(enumerate(lines)), "h long, line string")
    met = texts.selectExpr("h a").crossJoin(texts.selectExpr("h b")).where("a < b")
    of = lambda **k: sorted(tuple(x) for x in line_dedup.similar(met, texts, **k).collect())
    got = of()
    assert got == of(long=0) == of(long=100) and len(got) > 5
    want = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if jaccard_of(lines[a], lines[b]) >= 0.8]
    assert got == want


def jaccard_of(x, y):
    units = lambda t: t.encode("utf-16-be")
    runs = lambda t: {units(t)[2 * i : 2 * i + 16] for i in range(max(len(units(t)) // 2 - 7, 1))}
    return len(runs(x) & runs(y)) / len(runs(x) | runs(y))
