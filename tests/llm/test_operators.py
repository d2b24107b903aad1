"""Operators of the llm subpackage against brute force, and their edge cases."""

import collections
import hashlib
import html
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pitchflow.llm import extraction, graph, licenses, line_dedup, links, mixing, neighbours, ngram_join, packing, pairs, quality, queries, toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], DOC)


def empty(spark):
    return docs(spark, []).withColumns({"node": F.lit(1), "root": F.lit(2), "rate": F.lit(1.0), "h": F.lit(1)})


def awkward(spark):
    """Nulls, empty and long texts, repeated rows and clashing columns."""
    long = "word another thing here " * 20_000
    texts = [None, "", " \n\n ", "one", "a b c d e f", "a b c d e f", long, "x\ty\x0bz\x0c q\r\n\u00a0w", "漢字" * 50, "a b c d e f"]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, 4]
    d = docs(spark, texts, ids).withColumns({"node": F.lit(1), "root": F.lit(2), "rate": F.lit(1.0), "h": F.lit(1), "term": F.lit(3), "rule": F.lit("r"), "gone": F.lit(9), "_text": F.lit("t"), "key": F.lit("k")})
    return d.unionByName(d.limit(1).withColumn("doc_id", F.lit(None).cast("long")))


def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# quality


def slow_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    many = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if many[tuple(w[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_quality_counts(spark):
    r = random.Random(1)
    made = [" ".join(r.choice("ab") for _ in range(r.randint(0, 60))) for _ in range(100)] + ["é# ü\n" * 5]
    real = [x.text for x in table(spark, "documents").collect()]
    for t in made + real:
        assert quality.base_counts(t.encode()) == slow_counts(t)


def test_quality_verdicts(spark):
    d = table(spark, "documents")
    got = queries.op1_quality_rules(spark, SF).toPandas()
    assert len(got) == d.count()
    m = got.merge(labels(spark).toPandas(), on="doc_id")
    ok = m[~m.base_failed]
    assert (ok.kept == (ok.quality == 1)).mean() > 0.9
    crf = quality.train(d, labels(spark))
    assert "menu" not in quality.clean_lines(crf, "") and quality.judge(empty(spark), crf).count() == 0
    out = quality.judge(awkward(spark), crf).toPandas()
    assert len(out) == 11 and out.base_failed.sum() >= 9
    assert quality.judge(awkward(spark), crf, passing=True).count() == out.kept.sum()
    untrained = quality.train(d, labels(spark).limit(0))
    assert quality.content_share(untrained, b"a b\nc") == (3, 2)


def test_quality_marks_lines():
    """Menu lines around prose are boilerplate, the prose is content, and only its words count."""
    r, words = random.Random(2), "the sea was calm and we went home over long green fields under open skies".split()
    prose = lambda: " ".join(r.choices(words, k=30)).capitalize() + ", and " + " ".join(r.choices(words, k=9)) + "."
    junk = lambda: r.choice(["Home | About | Contact", ">> Next <<", "buy buy buy buy $$ ***", "Cookies & Terms | Login"])
    line = quality.line_features
    rows = [(line([prose().encode() for _ in range(4)]), 1) for _ in range(60)] + [(line([junk().encode() for _ in range(5)]), 0) for _ in range(60)]
    crf = quality.LineCrf().fit(quality.composed(rows))
    page = [junk(), junk(), prose(), prose(), prose(), junk()]
    assert crf.decode(line([x.encode() for x in page])) == [0, 0, 1, 1, 1, 0]
    assert quality.clean_lines(crf, "\n".join(page)) == "\n".join(page[2:5])
    assert quality.content_share(crf, "\n".join(page).encode()) == (sum(len(x.split()) for x in page[2:5]), 3)


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(0)
    crf = quality.LineCrf(r.standard_normal(2 * quality.N_FEATURES + 6))
    W, A, start = crf._parts(crf.theta)
    for n in range(1, 7):
        x = r.standard_normal((n, quality.N_FEATURES))

        def value(path, e=x @ W):
            return start[path[0]] + sum(e[i, s] for i, s in enumerate(path)) + sum(A[a, b] for a, b in zip(path, path[1:]))

        best = max((tuple(map(int, f"{k:0{n}b}")) for k in range(2**n)), key=value)
        assert abs(value(crf.decode(x)) - value(best)) < 1e-9


def test_crf_gradient():
    r = np.random.default_rng(1)
    crf = quality.LineCrf(r.standard_normal(2 * quality.N_FEATURES + 6) * 0.3)
    X = r.standard_normal((3, 4, quality.N_FEATURES))
    size, paths_ = np.array([4, 2, 1]), [(0, 1, 1, 0), (1, 0), (1,)]
    live = np.arange(4)[None] < size[:, None]
    X *= live[..., None]
    gold = np.zeros((3, 4, 2))
    for b, path in enumerate(paths_):
        gold[b, np.arange(len(path)), path] = 1
    w = np.array([0.2, 0.5, 0.3])

    def loss(theta):
        W, A, start = quality.LineCrf(theta)._parts(theta)
        out = 0.0
        for b in range(3):
            def score(p):
                return start[p[0]] + sum((X[b, i] @ W)[s] for i, s in enumerate(p)) + sum(A[i, j] for i, j in zip(p, p[1:]))

            paths = [tuple(map(int, f"{k:0{size[b]}b}")) for k in range(2 ** size[b])]
            out += w[b] * (score(paths_[b]) - np.logaddexp.reduce([score(p) for p in paths]))
        return out

    g = crf._gradient(X, gold, live, w)
    for i in range(len(g)):
        e = np.zeros_like(crf.theta)
        e[i] = 1e-5
        assert abs((loss(crf.theta + e) - loss(crf.theta - e)) / 2e-5 - g[i]) < 1e-5


# packing


def check_packing(spark, d, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = packing.pack_documents(d, public_tokenizers.path("word_bpe_49k.json"), with_ids=True).toPandas()
    for s, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= packing.CAPACITY
    for i, t in texts.items():
        want = tok.encode(t or "", add_special_tokens=False).ids + [packing.END_ID]
        g = out[out.doc_id == i].sort_values("start")
        assert g.start.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.doc_tokens.unique().tolist() == [len(want)]
        assert [x for p in g.ids for x in p] == want
        assert all(zlib.crc32(np.array(p, "<u4").tobytes()) == c for p, c in zip(g.ids, g.ids_crc32))
    return out


def test_packing(spark):
    d = table(spark, "documents")
    out = check_packing(spark, d, {r.doc_id: r.text for r in d.collect()})
    pad = sum(0 if x & (x - 1) == 0 else packing.CAPACITY - x for x in out.groupby("sequence_id").length.sum())
    assert pad < 0.04 * out.length.sum()
    assert packing.pack_documents(empty(spark), public_tokenizers.path("word_bpe_49k.json")).count() == 0
    texts = {0: None, 1: "", 2: "It's DON'T <|endoftext|> ABC, x\x1cy ÀÉ*** 12", 3: "ok " * 9000, 4: "漢字 ΑΣ x̧"}
    check_packing(spark, docs(spark, list(texts.values())), texts)
    assert packing.pack_documents(awkward(spark), public_tokenizers.path("word_bpe_49k.json")).where("doc_id is null").count() == 1


def test_packing_learns_words_of_texts_together():
    """Groups of texts give the tokenizer's own ids, and new letters are encoded once a group; long words are not kept."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, words = Tokenizer.from_file(path), packing.WordIds(path)
    texts = ["It's DON'T, it's", "don't ALPHA beta. 12", "", "x\x1cy beta", "beta " * 50 + "z" * 90 + " ÀÉ*** <|endoftext|>", "漢字 ΑΣ x̧ alpha,"] * 3
    asked, ask = [], words.ask
    words.ask = lambda text: asked.append(text) or ask(text)
    got = words.encode(texts)
    assert got == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert sum("alpha" in x for x in asked) == 1 and max(map(len, words.words)) < 64
    assert words.encode(texts) == got
    groups = list(packing.together(iter([(1, "a" * packing.TEXTS), (2, ""), (3, "b")])))
    assert groups == [[(1, "a" * packing.TEXTS)], [(2, ""), (3, "b")]]


def test_packing_keeps_words_for_the_next_task():
    """A Python worker's second task asks the tokenizer for no word of the first, and gives the same ids."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    words = packing.word_ids(path)
    assert packing.word_ids(path) is words
    texts = ["Alpha beta, gamma! 12", "delta Beta"]
    got = words.encode(texts)
    ask, words.ask = words.ask, None
    assert packing.word_ids(path).encode(texts) == got == packing.WordIds(path).encode(texts)
    words.ask = ask


def test_differencing_is_near_even():
    r = random.Random(2)
    sizes = [r.randint(1, 128) for _ in range(4000)]
    w = packing.differencing(sizes, 100)
    sums = np.bincount(w, sizes, 100)
    assert sums.sum() == sum(sizes) and sums.max() - sums.min() < 64
    assert packing.pack([])[1] == 1 and packing.pack([2048, 2048, 1])[1] == 3


# url filters


def page_rows(spark, urls, htmls):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(zip(urls, htmls))], "page_id long, url string, html string")


def test_links(spark, check_sql, tmp_path):
    r = random.Random(4)
    hosts = ["a.example.com", "b.example.net", "c.example.org", "d.other.io", "e.other.io", "f.other.io", "g.other.io"]
    urls = [f"https://{r.choice(hosts).upper()}/{r.choice(['en', 'de', 'es', 'x'])}/{r.randint(1, 90)}?q" for _ in range(200)] + [None, "", "no scheme", "http://", "x://h/en/7://y", "http://u/?a=://b"]
    htmls = ["".join(f'<a HREF = "{r.choice(["https:", "http:", ""])}//{r.choice(hosts[2:])}/p">' for _ in range(r.randint(0, 4))) for _ in urls[:-2]] + [None, ""]
    p = page_rows(spark, urls, htmls)
    p.coalesce(1).write.parquet(str(tmp_path / "w"))
    import glob
    import os
    import shutil

    for n in "region nation customer supplier part orders lineitem events documents embeddings benchmark labels conversations".split():
        os.symlink(f"{SF}/{n}.parquet", tmp_path / f"{n}.parquet")
    shutil.copy(glob.glob(str(tmp_path / "w" / "part*"))[0], tmp_path / "pages.parquet")
    check_sql(queries.op3_url_filters, links.oracle_sql(), str(tmp_path))
    got = links.judge(p.unionByName(p)).toPandas()
    assert len(got) == 2 * len(urls) and set(got[got.rule.isnull()].verdict) == {"allow", "block"}
    assert links.judge(p.limit(0)).count() == 0



# extraction


def test_extraction(spark):
    pages = table(spark, "pages")
    out = extraction.extract(pages).toPandas().set_index("page_id")
    hit = 0
    for p in pages.collect():
        a = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        a = re.sub(r"<[^>]+>", "", re.sub(r"<br>|</?(p|h1|div)>", " ", a))
        hit += out.loc[p.page_id].text == " ".join(html.unescape(a).split())
    assert hit >= 0.96 * len(out) and (out.n_chars == out.text.str.len()).all()
    for page, want in {
        "<p>a<noscript><p>b<p>c": ["a", "b", "c"], "<p>x<object><p>y</p>": ["x", "y"], "<head><title>t</title><body><p>hey</body>": ["hey"],
        "<p title=it's>hello</p>": ["hello"], "a < b and c > d <p>e": ["a < b and c > d", "e"], "<svg/>a<svg><title>q</title></svg>b": ["a b"],
    }.items():
        assert [b[1] for b in extraction.blocks(page)] == want, page
    import time

    for page in ("<title " * 8000, "<p a='\"' b=\"'" * 5000, "<" * 100_000, "<div>" * 20_000 + "x", "</" * 30_000, "<svg>" * 20_000):
        began = time.perf_counter()
        extraction.blocks(page)
        assert time.perf_counter() - began < 3
    odd = page_rows(spark, ["u"] * 4, [None, "", "<p>a<p>", "<div>" * 3000 + "x &amp; y"])
    assert extraction.extract(odd).count() == 4 and extraction.extract(odd.limit(0)).count() == 0
    assert [b[1] for b in extraction.blocks("<head><title>t</title></head><p>a <b>b</b>c<br>d<script>x</script><!-- y --><li>e")] == ["a bc d", "e"]


def test_labeller_held_out():
    data = extraction.training_data(60, 77)
    got = extraction.trained().label([b for b, _ in data])
    assert np.mean(np.concatenate([a == y for a, (_, y) in zip(got, data)])) > 0.95


# toxicity


def test_toxicity(spark):
    good = ["the sea was calm. we went home.", "a long day in the sun, nothing new"]
    r = random.Random(3)
    bags = []
    for i in range(300):
        s = " ".join(r.choice("sea calm home day sun new old road tree bird".split()) for _ in range(30)) + ". "
        y = i % 3 == 0
        bags.append((s + (f"you {r.choice(['vile', 'rotten'])} thing. " if y else "") + s, int(y)))
    m = toxicity.BagModel().fit(bags)
    score, spans = m.spans("Calm sea. You VILE thing! Home.")
    assert score > 0.9 and len(spans) == 1 and "VILE" in "Calm sea. You VILE thing! Home."[spans[0][0] : spans[0][1]]
    assert all(m.spans(x)[0] < 0.3 for x in good) and m.spans("")[0] == pytest.approx(toxicity.LEAK)
    assert toxicity.BagModel().fit(bags[1:2]).spans("vile")[0] == pytest.approx(toxicity.LEAK)
    out = toxicity.score(awkward(spark), m).toPandas()
    assert len(out) == 11 and out.score.between(0, 1).all() and toxicity.score(empty(spark), m).count() == 0
    q = queries.op5_toxicity(spark, SF).toPandas()
    assert (q.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in q.doc_id]).all()


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    q = queries.op5_toxicity(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    q = q[q.held_out]
    r, n = q.score.rank(), (q.toxic == 1).sum()
    assert (r[q.toxic == 1].sum() - n * (n + 1) / 2) / n / (len(q) - n) > 0.88


# neighbours


@pytest.mark.parametrize("part_rows", [20_000, 300])
def test_neighbours_at_larger_scale(spark, monkeypatch, part_rows):
    """All 20 queries of sf0.1, in one part a core and in parts of 300 rows; nine of ten true neighbours or more."""
    monkeypatch.setattr(neighbours, "PART_ROWS", part_rows)
    sf = "/root/testdata/sf0.1"
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    V, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    got = queries.op6_neighbours(spark, sf).toPandas()
    assert got.query_id.nunique() == (ids % 100 == 0).sum() and got.groupby("query_id").size().eq(10).all()
    hit = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((V - V[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        hit += len(set(ids[np.lexsort((ids, d))[:10]]) & set(g.vec_id))
    assert hit >= 0.9 * len(got)


def test_neighbours_hot_id(spark):
    """Many rows of one id are dealt to all parts and none is its own neighbour."""
    r = np.random.default_rng(3)
    rows = [(100, r.normal(size=8).tolist()) for _ in range(700)] + [(i, r.normal(size=8).tolist()) for i in range(101, 900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = neighbours.search(df, neighbours.stated_queries(df)).toPandas()
    assert set(out.query_id) == {100, *range(200, 900, 100)} and (out.query_id != out.vec_id).all()


def test_neighbours(spark):
    rows = table(spark, "embeddings")
    e = rows.toPandas()
    V, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    got = queries.op6_neighbours(spark, SF).toPandas()
    hit = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((V - V[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:10]
        hit += len(set(ids[best]) & set(g.vec_id))
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 11)) and np.allclose(g.score, d[[list(ids).index(v) for v in g.vec_id]], rtol=0, atol=1e-12)
    assert hit >= 0.9 * 10 * got.query_id.nunique()


def test_neighbours_edges(spark):
    v = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, [0.0, 2.0]), (100, [0.0, 0.0]), (200, []), (0, [1.0, 0.0])]
    df = spark.createDataFrame([(i, x, 0, 5) for i, x in v], "vec_id long, embedding array<float>, label int, score int")
    out = neighbours.search(df, neighbours.stated_queries(df)).orderBy("rank").toPandas()
    assert out.query_id.unique().tolist() == [0] and out.vec_id.tolist() == [1, 2, 8] and out.score.tolist()[:2] == [0.0, 0.0]
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0


# licences


def test_licenses(spark, check_sql):
    check_sql(queries.op7_license_scans, licenses.oracle_sql())
    mit = licenses.BODIES["MIT"]
    texts = [mit, "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + mit.replace(", ", ",\n  "), mit.upper().replace("SUBLICENSE", "sub-licence"), mit + " more", None, "", "© 2020 X", "x" * 300_000, mit]
    got = licenses.scan(docs(spark, texts).withColumn("license", F.lit("x"))).orderBy("doc_id").toPandas()
    assert got.license.where(got.license.notna(), None).tolist() == ["MIT", "MIT", "MIT", None, None, None, None, None, "MIT"]
    assert licenses.scan(empty(spark)).count() == 0 and len(set(licenses.known().values())) == 25


def test_licenses_full_texts_and_holders(spark):
    import pathlib

    folder = pathlib.Path("/usr/share/common-licenses")
    if not (folder / "Apache-2.0").exists():
        pytest.skip("no published texts here")
    mit = licenses.BODIES["MIT"]
    heads = ["Copyright Joyent, Inc.", "Copyright The Authors.", "Portions Copyright (c) 2020 Foo", "Copyright Foo 2020", "Copyright 2020 Foo\nAll rights reserved."]
    texts = [(folder / "Apache-2.0").read_text(), (folder / "GPL-3").read_text().upper().replace(" ", "\n"), *[f"MIT License\n{h}\n\n{mit}" for h in heads], "favour favour", "favor favor"]
    names = ["Holmes Ltd", "Linus Torvalds", "Owen Smith", "by The Authors", "Notary Inc.", "Lawson & Sons", "Holders and Sons"]
    named = [f"MIT License\nCopyright {x}\n\n{mit}" for x in names] + [f"MIT License\nCopyright Law applies.\n\n{mit}", f"Copyright Notice\n{mit}"]
    assert [r.license for r in licenses.scan(docs(spark, named)).orderBy("doc_id").collect()] == ["MIT"] * 6 + [None] * 3
    assert [licenses.known().get(hashlib.sha256(licenses.canonical(t).encode()).hexdigest()) for t in named] == ["MIT"] * 6 + [None] * 3
    got = [(r.license, r.digest) for r in licenses.scan(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got[0][0] == "Apache-2.0" and [x for x, _ in got[2:7]] == ["MIT"] * 5 and got[7][1] == got[8][1]
    own = spark.createDataFrame([("OURS", "Our own words.")], "license string, text string")
    assert [r.license for r in licenses.scan(docs(spark, ["our OWN words", mit, "x"]), own).orderBy("doc_id").collect()] == ["OURS", "MIT", None]


# line dedup


def jaccard(a, b):
    return len(a & b) / len(a | b)


def line_runs(x):
    return {x} if len(x) <= line_dedup.WIDTH else {x[i : i + line_dedup.WIDTH] for i in range(len(x) - line_dedup.WIDTH + 1)}


def slow_lines(rows):
    """doc_id to gone places, all pairs of lines."""
    placed = [(i, p, x) for i, t in rows for p, x in enumerate(t.split("\n")) if x.strip()]
    kinds = sorted({x for *_, x in placed})
    sets, up = [line_runs(x) for x in kinds], list(range(len(kinds)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(kinds)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    first, gone = {}, collections.defaultdict(list)
    for i, p, x in sorted(placed):
        k = find(kinds.index(x))
        if first.setdefault(k, (i, p)) != (i, p):
            gone[i].append(p)
    return dict(gone)


def test_line_dedup(spark):
    r = random.Random(8)
    ws = [("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))) for _ in range(400)]
    base = [" ".join(r.choices(ws, k=40)) for _ in range(12)]

    def near(x):
        w = x.split(" ")
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = r.choice(ws)
        return " ".join(w)

    rows = [(i, "\n".join(r.choice([near(r.choice(base)), " ".join(r.choices(ws, k=25)), "", "short"]) for _ in range(4))) for i in range(60)]
    got = {x.doc_id: x.gone for x in line_dedup.dropped(docs(spark, [t for _, t in rows])).collect()}
    want = slow_lines(rows)
    wrong = sum(got.get(i, []) != want.get(i, []) for i, _ in rows)
    assert wrong <= 2 and len(want) > 20
    d = line_dedup.dedup(awkward(spark).withColumn("n_gone", F.lit(7))).toPandas()
    assert (d.gone == 9).all() and d[d.doc_id == 5].n_gone.item() == 1
    assert len(d) == 11 and d[d.doc_id == 5].text.item() == "" and (d[d.doc_id == 4].text == "a b c d e f").all()
    assert line_dedup.report(awkward(spark)).count() == 11 and line_dedup.report(empty(spark)).count() == 0


def test_line_dedup_recall(spark):
    """One character replaced in short, single-token and no-space lines, against the exact Jaccard."""
    r = random.Random(12)
    word = lambda n, of="abcdefghijklmnopqrstuvwxyz0123456789": "".join(r.choice(of) for _ in range(n))
    thai = "".join(map(chr, range(0x0E01, 0x0E2F)))
    makers = {
        "two words": lambda: word(70) + " " + word(50), "three words": lambda: " ".join(word(40) for _ in range(3)),
        "one token": lambda: word(160), "url": lambda: "https://" + word(9) + ".org/" + word(130), "thai": lambda: word(150, thai),
    }
    for kind, make in makers.items():
        pairs = []
        while len(pairs) < 120:
            a = make()
            at = r.randrange(len(a))
            b = a[:at] + "#" + a[at + 1 :]
            if 100 * len(line_runs(a) & line_runs(b)) >= 80 * len(line_runs(a) | line_runs(b)):
                pairs.append(f"{a}\n{b}")
        got = {x.doc_id for x in line_dedup.dropped(docs(spark, pairs)).collect()}
        assert len(got) >= 118, (kind, len(got))


def test_line_dedup_recall_long(spark):
    """Long lines, which are signed by their least hashes: words replaced, cut off, and lines that repeat themselves."""
    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
    makers = {"prose": lambda n: [word() for _ in range(n)], "repeats": lambda n: [w for w in [word() for _ in range(n // 8)] for _ in range(8)]}
    for kind, make in makers.items():
        pairs, n = [], 0
        while len(pairs) < 100:
            a = make(r.choice([60, 120, 400]))
            b = a[: len(a) - r.randint(0, len(a) // 10)]
            for _ in range(r.randint(0, len(a) // 60)):
                b[r.randrange(len(b))] = word()
            a, b = " ".join(a), " ".join(b)
            if a != b and 100 * len(line_runs(a) & line_runs(b)) >= 80 * len(line_runs(a) | line_runs(b)):
                pairs.append(f"{a}\n{b}")
        got = {x.doc_id for x in line_dedup.dropped(docs(spark, pairs)).collect()}
        assert len(got) >= 98, (kind, len(got))
    # one set each, at very different lengths
    bars = ["=" * 300 + "\n" + "=" * 1000]
    assert line_dedup.dropped(docs(spark, bars)).collect()[0].gone == [1]


def test_line_dedup_bands():
    """At the Jaccard asked for, fewer than one pair in a thousand never meets."""
    assert (1 - (line_dedup.PERCENT / 100) ** line_dedup.ROWS) ** line_dedup.BANDS < 1e-3


def test_line_dedup_signatures_are_full(spark):
    """Reading the least hashes first gives the keys of a full reading, at every length and for lines that repeat themselves."""
    r = random.Random(9)
    lines = ["".join(r.choices("abcdefgh ijkl", k=n)) for n in (3, 20, 100, 180, 190, 260, 400, 900, 5000) for _ in range(6)]
    lines += ["abcdefghijk" * 60, "=" * 700, "na " * 500 + "x", "".join(r.choices("ab", k=3000))]
    d = line_dedup.lines_of(docs(spark, lines))
    first, second = line_dedup.signatures(d)
    keys = lambda df: {x.h: sorted(x["keys"]) for x in df.collect()}
    got = keys(first.df) | keys(second.df)
    assert got == keys(line_dedup._bands(d, True)) and len(got) == len(set(lines)) and second.df.count() >= 1


def test_line_dedup_reads_few_lines_twice(spark):
    """Long lines that do not repeat themselves seldom leave a bin empty at the first reading."""
    r = random.Random(10)
    lines = ["".join(r.choices("abcdefgh ijkl", k=n)) for n in (250, 400, 900, 3000) for _ in range(30)]
    first, second = line_dedup.signatures(line_dedup.lines_of(docs(spark, lines)))
    assert first.df.count() + second.df.count() == 120 and second.df.count() <= 6


def test_line_dedup_bounds_hold(spark):
    """The bitmaps of cells and the sizes given as intervals rule out no pair of lines that is similar, and most that are not."""
    r = random.Random(11)
    base = ["".join(r.choices("abcdefgh ijkl", k=n)) for n in (5, 30, 300, 1500, 4000)] + ["ab" * 400, "=" * 900, "na " * 300 + "x"]
    near = [x[: int(len(x) * cut)] for x in base for cut in (0.97, 0.85, 0.6)]
    lines = sorted({*base, *near, *["".join(r.choices("mnopqrst", k=300)) for _ in range(5)]})
    d = line_dedup.lines_of(docs(spark, lines))
    text = {x.h: x.line for x in d.collect()}
    feats = line_dedup.features(d.select("h", "line"))
    for x in feats.collect():
        assert x.least <= len(line_runs(text[x.node])) <= x.n
    a, b = pairs.spread(feats, line_dedup.WORDS, "a"), pairs.spread(feats, line_dedup.WORDS, "b")
    fit = pairs.bounds(line_dedup.PERCENT, line_dedup.WORDS)
    fits = {(x.a, x.b) for x in a.crossJoin(b).where(fit).select("a", "b").collect()}
    alike = {(x, y) for x in text for y in text if jaccard(line_runs(text[x]), line_runs(text[y])) >= 0.8}
    assert alike <= fits
    plain = {x for x in text if len(set(text[x])) > 3}
    more = {(x, y) for x, y in fits - alike if x in plain and y in plain}
    assert len(more) < 0.1 * len(plain) ** 2


def test_components_carried_on(spark):
    """New links joined to known components give what all links together give."""
    r = random.Random(4)
    edge = lambda: (r.randint(-200, 200), r.randint(-200, 200))
    old, new = [edge() for _ in range(150)], [edge() for _ in range(60)]
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    whole = {tuple(x) for x in graph.components(frame(old + new)).select("node", "root").collect()}
    known = graph.components(frame(old))
    assert {tuple(x) for x in pairs.carried_on(known, frame(new)).select("node", "root").collect()} == whole
    assert pairs.carried_on(known, frame([])) is known


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randint(-50, 200), r.randint(-50, 200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1040)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(find(n) == got.get(n, n) for n in list(up))


# mixing


def test_mixing(spark):
    r = random.Random(5)
    voc = {"en": "the and of to in".split(), "de": "der und die das in".split(), "fr": "le la et de in".split(), "es": "el los y de en".split()}
    rows = [(i, " ".join(r.choices(voc[k], k=r.randint(20, 80))), k, "s", 0) for i in range(240) for k in ["en" if i % 2 else r.choice(["de", "fr", "es"])]]
    d = spark.createDataFrame(rows, DOC)
    lab = spark.createDataFrame([(i, 1, 0) for i in range(0, 240, 2)] + [(i, 1, 0) for i in range(1, 240, 6)], "doc_id long, quality int, toxic int")
    out = mixing.rates(d, lab).toPandas()
    total = out.n_tokens.sum()
    for k, t in mixing.TARGETS.items():
        assert abs((out.rate * out.n_tokens * out[f"p_{k}"]).sum() / total - t) < 0.01
    assert (out.rate >= 0).all()
    again = mixing.rates(d.repartition(7), lab).toPandas()
    key = lambda f: f.sort_values("doc_id").values.tolist()
    assert key(again) == key(out)
    a = mixing.rates(awkward(spark).drop("rate"), lab).toPandas().set_index("doc_id")
    assert a.loc[1].rate == 1.0 and len(a) == 9 and mixing.rates(empty(spark), lab).count() == 0
    mixed = mixing.mix(d, lab)
    assert mixed.columns == d.columns and mixed.count() > 0 and mixing.mix(empty(spark), lab).count() == 0
    clash = d.withColumns({c: F.lit(3) for c in ("times", "time", "rate", "_times", "_id", "p0", "n_tokens")})
    odd = mixing.mix(clash, lab)
    assert odd.columns == clash.columns and odd.count() == mixed.count() and odd.where("time <> 3 or times <> 3").count() == 0
    assert mixing.mix(awkward(spark).drop("rate"), lab.limit(0)).where("doc_id is null").count() == 1


@pytest.mark.parametrize("own", [1.0, 0.85])
def test_mixing_small_domains(spark, own):
    """A domain with a hundredth of the tokens meets its target; targets out of reach are reported."""
    kinds = [0] * 900 + [1] * 60 + [2] * 30 + [3] * 10
    rows = [(i, 100 + i % 7, *[own if j == k else (1 - own) / 3 for j in range(4)]) for i, k in enumerate(kinds)]
    soft = spark.createDataFrame(rows, "doc_id long, n_tokens long, p0 double, p1 double, p2 double, p3 double")
    out = mixing.fit(soft, [0.4, 0.2, 0.2, 0.2]).toPandas()
    for k, t in enumerate([0.4, 0.2, 0.2, 0.2]):
        assert abs((out.rate * out.n_tokens * out[f"p{k}"]).sum() / out.n_tokens.sum() - t) < 2 * mixing.CLOSE
    assert (out.rate >= 0).all()
    with pytest.warns(RuntimeWarning, match="residuals"):
        mixing.fit(soft.where("p0 > 0.5"), [0.4, 0.2, 0.2, 0.2])


# n-gram join


def slow_join(rows):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()

    sets = {i: grams(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check_join(spark, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked(docs(spark, [t for _, t in rows], [i for i, _ in rows])).collect()}
    assert got == slow_join(rows)


def test_ngram_join(spark):
    r = random.Random(6)
    rows = []
    for g in range(14):
        n = r.choice([3, 8, 12, 17, 18, 25, 40, 90, 200])
        base = [r.choice("abcdefghijklmnopqrstuvwxyz") * r.randint(1, 3) for _ in range(n)]
        for _ in range(7):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                at = r.randrange(len(w))
                w[at : at + r.choice([0, 1])] = [r.choice(["Q", "zz", "y"])] * r.choice([0, 1])
            rows.append((len(rows) * 3, " ".join(w)))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(1000 + i, " ".join(f"u{i}x{k}" for k in range(r.choice([5, 9, 12, 40]))) + " " + passage) for i in range(25)]
    rows += [(2000, None), (2001, ""), (2002, "a"), (2003, "A"), (2004, "a b"), (2005, " \t"), (2006, "x\u00a0y z")]
    check_join(spark, rows)


def test_ngram_join_edges(spark):
    assert ngram_join.linked(empty(spark)).count() == 0
    out = ngram_join.linked(awkward(spark)).toPandas()
    assert len(out) == 11 and out[out.doc_id == 5].component_id.item() == 4


def test_ngram_join_light_side(spark, monkeypatch):
    """Short texts over two words: their lists are long, so subsets are cheaper and find the links."""
    r = random.Random(8)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randint(9, 12)))) for i in range(400)]
    chosen, real = [], ngram_join.boundary
    monkeypatch.setattr(ngram_join, "boundary", lambda s, *a: chosen.append((real(s, *a), s.least)) or chosen[-1][0])
    check_join(spark, rows)
    assert chosen[0][0] >= chosen[0][1]
    monkeypatch.setattr(ngram_join, "boundary", lambda s, *a: s.most_light)
    check_join(spark, rows)


def test_ngram_join_over_rows_without_id(spark):
    """A row without doc_id links its neighbours as any other does."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:50]), " ".join(words[3:53]), " ".join(words[6:56])]
    ends = slow_join([(1, texts[0]), (3, texts[2])])
    assert ends[1][1] != ends[3][1]
    out = ngram_join.linked(docs(spark, texts, [1, None, 3])).collect()
    assert {(r.doc_id, r.component_id) for r in out} == {(1, 1), (None, 1), (3, 1)}


def test_scheme_lists_every_pair():
    """Any two sets that link share a listed n-gram, and a subset where both are light, whatever the rarity."""
    r = np.random.default_rng(7)
    for s in (ngram_join.Scheme(85, r.integers(0, 127, ngram_join.SLOTS).astype(np.uint8)), ngram_join.Scheme(80)):
        for size in [*range(1, 30), 60, 150, 700]:
            for _ in range(12):
                a = r.integers(0, 1 << 63, size, dtype=np.uint64)
                most = int(size * 15 / 185 * 2)
                drop, add = r.integers(0, most + 1), r.integers(0, most + 1)
                b = np.concatenate([a[drop:], r.integers(0, 1 << 63, add, dtype=np.uint64)])
                a, b, common = np.unique(a), np.unique(b), size - drop
                if common < max(len(a), len(b)) and 100 * common >= s.percent * (size + add):
                    assert set(s.listed(a).tolist()) & set(s.listed(b).tolist())
                    if max(len(a), len(b)) <= s.most_light:
                        assert set(s.enumerated(a).tolist()) & set(s.enumerated(b).tolist())
                    apart = np.unpackbits((ngram_join.bitmap(a) ^ ngram_join.bitmap(b)).view(np.uint8)).sum()
                    assert apart <= len(a) + len(b) - 2 * common


def test_ngram_join_one_id_many_texts(spark):
    """Rows that share a doc_id are one document; ids beside a null keep their last digit."""
    texts = ["a b c d e f g", "t u v w x y z", "t u v w x y z", None]
    out = ngram_join.linked(docs(spark, texts, [5, 5, 7, 9007199254740993])).toPandas()
    assert sorted(zip(out.doc_id, out.component_id)) == [(5, 5), (5, 5), (7, 5), (9007199254740993, 9007199254740993)]
    for run in (ngram_join.linked, lambda d: toxicity.score(d, toxicity.BagModel()), lambda d: quality.judge(d, quality.LineCrf()), lambda d: packing.pack_documents(d, public_tokenizers.path("word_bpe_49k.json"))):
        assert {r.doc_id for r in run(docs(spark, texts[:2], [None, 9007199254740993])).collect()} == {None, 9007199254740993}
