"""Spelling variants: words one edit apart, each sent to its far more frequent neighbour.

The words form a trie whose nodes are prefixes. At every node the child with the most words
below it is the heavy one; a word passes at most log2(words) light edges. One-edit pairs are
found where the two words part, from the light side alone (small-to-large): at each of its
light edges (prefix p, character c, rest s, heavy child h) a word is merged into what hangs
there

- with c skipped: p s, unless s starts with c (the pair then parts further down),
- with h put before c: p h c s,
- with c replaced by h: p h s,
- with c replaced by a mark, among the light subtrees of p: they meet in p * s;

a word that ends at p takes part as p h. Terminals that coincide are one-edit pairs, each
found once, at the place where the words part. Nodes are 64-bit hashes of prefixes: where two
share a hash they share a heavy child, which costs probes and no pair, as any child will do
that all words at a node agree on. Probes are whole strings.

Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lowered, of at least
`SHORTEST` code points and `LEAST` occurrences. `docs` may be read with planted errors: where
31 divides the crc32 of `<doc_id>:<run>`, the run has lost the code point crc32 % length
(a row without doc_id has nothing before the colon). Null and empty texts have no words;
repeated rows count each; other columns are not looked at; without words the result is empty.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, text_id

SHORTEST, LEAST, FACTOR = 7, 2, 10
HELD = 300_000
_RUN = re.compile(f"[a-zÀ-ÿ]{{{SHORTEST},}}")
_MASK, _STEP = (1 << 64) - 1, 0x9E3779B97F4A7C15


def misspelt(prefix: int, run: str) -> str:
    """run, or run less one code point where its crc32 after the prefix's says so."""
    h = zlib.crc32(run.encode(), prefix)
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words(docs: DataFrame, errors: bool = True) -> DataFrame:
    """word, n of docs (doc_id, text); with `errors`, as the module says."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return made

        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                if not t.is_valid:
                    continue
                # bytes lower A-Z alone
                runs = Counter(_RUN.findall(t.as_buffer().to_pybytes().lower().decode(errors="replace")))
                if errors:
                    start = zlib.crc32(f"{i or ''}:".encode())
                    for run, k in runs.items():
                        w = misspelt(start, run)
                        if len(w) >= SHORTEST:
                            total[w] += k
                else:
                    total.update(runs)
                if len(total) > HELD:
                    yield out()
        yield out()

    parts = docs.select(text_id("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def edges(words: DataFrame) -> DataFrame:
    """v, c, id, at for each node v on the path of each word (id, word): its next code point c (-1: the word ends) and how many stand before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 2000):
                part = b.slice(lo, 2000)
                v, c = [], []
                ids, own = part.column("id").to_numpy(zero_copy_only=False), part.column("word").to_pylist()
                for w in own:
                    h = 0
                    for x in w:
                        k = ord(x)
                        v.append(h)
                        c.append(k)
                        h = ((h ^ k) * _STEP & _MASK) ^ (h >> 29)
                    v.append(h)
                    c.append(-1)
                length = np.array([len(w) + 1 for w in own], np.int64)
                at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(v, np.uint64).view(np.int64)), pa.array(np.array(c, np.int32)), pa.array(np.repeat(ids, length)), pa.array(at.astype(np.int32))],
                    ["v", "c", "id", "at"],
                )

    return words.select("id", "word").mapInArrow(run, "v long, c int, id long, at int")


def heavy(edges: DataFrame) -> DataFrame:
    """v, h: the child with the most words of each node at which words part or one ends before another."""
    children = edges.groupBy("v", "c").agg(F.count("*").alias("below"))
    weight = F.when(F.col("c") >= 0, F.struct("below", "c"))
    nodes = children.groupBy("v").agg(F.count("*").alias("ways"), F.max(weight).alias("most"))
    return nodes.where("ways > 1").select("v", F.col("most.c").alias("h"))


def probes(words: DataFrame, paths: DataFrame) -> DataFrame:
    """key, met, word, n: what each word (id, word, n) is looked for as; met marks keys that light subtrees share."""
    light = paths.join(heavy(paths), "v").where("c <> h").select("id", "at", "c", "h")
    # a code point from U+0000 to U+00FF as text
    p, s, h = F.expr("substring(word, 1, at)"), F.expr("substring(word, at + 2)"), F.chr("h")
    same = F.col("c") < 0
    own = F.chr(F.greatest("c", F.lit(0)))
    keys = F.array(
        F.struct(F.when(~same & ~s.startswith(own), F.concat(p, s)).alias("key"), F.lit(False).alias("met")),
        F.struct(F.when(same, F.concat(p, h)).otherwise(F.concat(p, h, own, s)).alias("key"), F.lit(False).alias("met")),
        F.struct(F.when(~same, F.concat(p, h, s)).alias("key"), F.lit(False).alias("met")),
        F.struct(F.when(~same, F.concat(p, F.lit("*"), s)).alias("key"), F.lit(True).alias("met")),
    )
    found = light.join(words, "id").select("word", "n", F.explode(keys).alias("k"))
    return found.select("k.key", "k.met", "word", "n").where(F.length("key") >= SHORTEST)


def near(words: DataFrame) -> DataFrame:
    """word, n_near, best (least of -n, word, over its near words) of the words (id, word, n) that have any.

    Words that meet in one marked key differ in one character, so such a group is no larger
    than the alphabet.
    """
    paths = Stored(edges(words))
    found = Stored(probes(words, paths.df))
    paths.drop()
    rank = lambda n, w: F.struct((-F.col(n)).alias("less"), F.col(w).alias("form"))
    one = found.df.where("not met").select("key", F.col("word").alias("a"), F.col("n").alias("na"))
    pairs = one.join(words.select(F.col("word").alias("key"), F.col("n").alias("nb")), "key")
    both = F.array(F.struct(F.col("a").alias("word"), rank("nb", "key").alias("best")), F.struct(F.col("key").alias("word"), rank("na", "a").alias("best")))
    linked = pairs.select(F.explode(both).alias("x")).select("x.word", F.lit(1).cast("long").alias("k"), "x.best")
    groups = found.df.where("met").groupBy("key").agg(F.sort_array(F.collect_list(rank("n", "word"))).alias("all")).where(F.size("all") > 1)
    of = F.transform("all", lambda x, i: F.struct(x["form"].alias("word"), F.when(i == 0, F.get("all", F.lit(1))).otherwise(F.get("all", F.lit(0))).alias("best")))
    met = groups.select((F.size("all") - 1).cast("long").alias("k"), F.explode(of).alias("x")).select("x.word", "k", "x.best")
    return linked.unionByName(met).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root over forms (word, form): the last of the forms that follow each other.

    Each round doubles the steps taken. A form occurs `FACTOR` times as often as its word, so
    no chain is longer than the logarithm of the largest count.
    """
    now = Stored(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.df.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = now.df.join(on, "root", "left")
        if moved.where("next is not null").isEmpty():
            return now.df
        last, now = now, Stored(moved.select("word", F.coalesce("next", "root").alias("root")))
        last.drop()


def variants(docs: DataFrame, errors: bool = True) -> DataFrame:
    """word, n, n_near, form, form_n, root for each word of docs (doc_id, text)."""
    own = Stored(words(docs, errors).withColumn("id", F.monotonically_increasing_id())).df
    best = own.join(near(own), "word", "left")
    fits = -F.col("best.less") >= FACTOR * F.col("n")
    formed = Stored(
        best.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))
    ).df
    last = roots(formed.where("form is not null"))
    return formed.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
