"""The corpus pipeline: stages in order, columns kept, decisions effective."""

import random

import corpus_pipeline as P
from pitchflow.llm import quality
from pitchflow.llm.common import table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_pipeline(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(P.STAGES):
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert {r.doc_id for r in out.select("doc_id").collect()} <= before
        if k < len(P.STAGES) - 1:
            assert out.columns == columns
        docs = out
        seen.append(name)
    assert seen == ["quality_rules", "line_dedup", "ngram_join", "mixing", "packing"]
    assert P.run(spark, SF).count() == docs.count()


def test_quality_stage_matches_brute_force(spark):
    docs = table(spark, SF, "documents")
    crf = quality.train(docs, table(spark, SF, "labels"))
    want = {r.doc_id for r in docs.collect() if quality.verdict(crf, r.text.encode())[6]}
    assert {r.doc_id for r in P.quality_stage(spark, docs, SF).collect()} == want


def test_empty(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0


def rewrapped(seed, widths, words=240):
    """The same words in lines of other widths: no line of one is like a line of the other."""
    r = random.Random(seed)
    text = ["".join(r.choices("abcdefghijklmnop", k=r.randint(3, 9))) for _ in range(words)]
    return ["\n".join(" ".join(text[i : i + w]) for i in range(0, words, w)) for w in widths]


def test_near_copies_that_survive_the_line_stage(spark):
    """Copies with other line breaks keep their lines, and the n-gram stage leaves one of them."""
    texts = rewrapped(1, (7, 19, 41)) + rewrapped(2, (11,)) + rewrapped(3, (23, 60))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    lines = P.line_stage(spark, docs, SF).collect()
    assert {r.doc_id: r.text for r in lines} == dict(enumerate(texts))
    left = P.near_duplicate_stage(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in left) == [0, 3, 4] and all(r.text == texts[r.doc_id] for r in left)


CLASHING = ["node", "root", "key", "a", "b", "h", "line", "place", "gone", "rate", "n_tokens", "component_id", "n_shingles", "_row", "_id", "_times", "_gone", "_text", "window", "offset", "start"]


def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, clashing columns."""
    long = "\n".join(f"line {i} of a text that goes on and on without an end" for i in range(4000))
    some = "A plain line of prose that says a little about the sea, the wind and the way home."
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, some, None, None, None), (4, some, "en", "s", 9), (4, some, "en", "s", 9), (5, long, "de", "s", 9), (None, some, "fr", "s", 9), (None, None, None, None, None), (6, " \n\n ", "en", "s", 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return d.withColumns({c: F.lit(1) for c in CLASHING})


def test_stages_on_odd_rows(spark):
    d = odd(spark)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect() if r.doc_id is not None)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns, name
        assert set(ids(out)) <= {1, 2, 3, 4, 5, 6}
        assert out.where("node = 1").count() == out.count()
    # of each line one stays in documents; documents without one go, rows without doc_id stay what they are
    kept = P.line_stage(spark, d, SF).collect()
    assert sum(r.text.count("plain line of prose") for r in kept if r.doc_id) == 1 and [r.text for r in kept if r.doc_id is None] == ["A plain line of prose that says a little about the sea, the wind and the way home."] and len([r for r in kept if r.doc_id == 5]) == 1
    # documents without n-grams stand alone; a document in two rows keeps both
    assert ids(P.near_duplicate_stage(spark, d, SF)) == [1, 2, 3, 5, 6]
    packed = P.packing_stage(spark, d, SF).collect()
    assert {r.doc_id for r in packed} >= {1, 2, 3, 4, 5, 6}
