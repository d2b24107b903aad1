"""N-gram Jaccard join: documents whose sets of word n-grams have a Jaccard of T or more.

The size-aware heavy-light join. Heavy sets are found by scanning inverted lists: a set is
listed under its rarest n-grams, as many as two partners cannot miss each other in (all but
the overlap they must have, and one). Rarity is counted over all documents, in a table of
`SLOTS` counters by hash; where n-grams share a counter the order is less sharp, never
wrong. Light sets are those with few subsets as large as a partner's overlap: all of them
are enumerated, and partners meet in one. The boundary between the two is the size at which
the measured lengths of the lists that light sets would scan, summed, cost more than their
subsets (`boundary`). A light set whose partner may be heavy is listed as well.

Sets that meet are linked as pairs.py says: stars, exact bounds by size and bitmap, and the
exact overlap of both texts' n-grams. Equal sets are one node. No link between components
is lost, nor is any list cut.

N-grams and sets are held as 64-bit hashes. Null and empty texts have no n-grams and no
links; texts with fewer words than n are one n-gram. Rows that share a doc_id are one
document: its sets are in one component, and it keeps a row each; a row without n-grams has
its own doc_id, a row without doc_id that of equal sets, if any, else null. Columns other
than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, count
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pairs
from .common import Stored

SLOTS, BLOCK = 1 << 20, 1 << 12
MOST_SUBSETS = 200
WORDS = 32
CACHE = 300_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def times(a: int, b: np.uint64) -> np.uint64:
    return np.uint64(a * int(b) & 0xFFFFFFFFFFFFFFFF)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes, n: int, words: WordHashes) -> np.ndarray:
    """Distinct hashes of the word n-grams, in order. A-Z are lowered."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    width = min(n, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for i in range(width):
        h = h * _M1 + w[i : i + len(h)]
    return np.unique(mixed(h))


class Scheme:
    """Sizes and terms for a threshold of percent / 100; rarity: a byte for each slot, rising with the count."""

    def __init__(self, percent: int, rarity: np.ndarray | None = None):
        self.percent = percent
        self.rarity = np.zeros(SLOTS, np.uint8) if rarity is None else rarity
        # smaller sets link with equal ones alone
        self.least = -(-percent // (100 - percent)) if percent < 100 else 1 << 60
        self.most_light = self.least - 1
        while self.subsets(self.most_light + 1) <= MOST_SUBSETS and self.most_light < 60:
            self.most_light += 1

    def least_overlap(self, size: int) -> int:
        return -(-size * self.percent // 100)

    def largest(self, size: int) -> int:
        """The size of its largest partner."""
        return size * 100 // self.percent

    def subsets(self, size: int) -> int:
        return sum(comb(size, o) for o in range(self.least_overlap(size), size + 1))

    def listed(self, h: np.ndarray) -> np.ndarray:
        """The rarest n-grams, enough to share one with every partner; a term starts with its rarity."""
        size = len(h)
        if size < self.least:
            return np.zeros(0, np.int64)
        k = size - self.least_overlap(size) + 1
        term = (self.rarity[slot(h)].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
        return np.partition(term, k - 1)[:k].view(np.int64)

    def enumerated(self, h: np.ndarray) -> np.ndarray:
        """Digests of all subsets that may be the overlap with a partner, of light sets."""
        size = len(h)
        if not self.least <= size <= self.most_light:
            return np.zeros(0, np.int64)
        out = [mixed(h[np.array(list(combinations(range(size), o)))].sum(1) + times(o, _M1)) for o in range(self.least_overlap(size), size + 1)]
        return np.unique(np.concatenate(out)).view(np.int64)


def slot(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(SLOTS)).astype(np.int64)


def sets_of(texts: pd.Series, n: int, words: WordHashes) -> list[np.ndarray]:
    return [shingles(bytes(t) if t is not None else b"", n, words) for t in texts]


def rarity(docs: DataFrame, n: int) -> np.ndarray:
    """A byte for each slot: eight times the binary logarithm of how many sets have an n-gram there."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, total = WordHashes(), np.zeros(SLOTS, np.int64)
        for whole in batches:
            for lo in range(0, len(whole), 500):
                sets = sets_of(whole["text"].iloc[lo : lo + 500], n, words)
                total += np.bincount(slot(np.concatenate(sets)), minlength=SLOTS)
        blocks = total.reshape(-1, BLOCK)
        some = [i for i in range(len(blocks)) if blocks[i].any()]
        yield pd.DataFrame({"block": some, "counts": [blocks[i].astype("<u4" if blocks[i].max() < 1 << 32 else "<u8").tobytes() for i in some]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b["block"], b["counts"]):
                total[k] = total.get(k, 0) + np.frombuffer(c, "<u4" if len(c) == 4 * BLOCK else "<u8").astype(np.int64)
        yield pd.DataFrame({"block": list(total), "counts": [c.astype("<u8").tobytes() for c in total.values()]})

    schema = "block int, counts binary"
    parts = docs.select(F.col("text").cast("binary").alias("text")).mapInPandas(count, schema)
    out = np.zeros((SLOTS // BLOCK, BLOCK))
    for r in parts.repartition("block").mapInPandas(add, schema).collect():  # SLOTS counters, whatever the input
        out[r.block] = np.frombuffer(bytes(r.counts), "<u8")
    return np.minimum(8 * np.log2(out.ravel() + 1), 127).astype(np.uint8)


_SETS = "doc_id string, n_shingles long, node long, bits array<long>, listed array<long>, enumerated array<long>"


def signed(docs: DataFrame, n: int, percent: int, order: np.ndarray) -> DataFrame:
    """doc_id, n_shingles, node (the set's digest, null if empty); for the first row of a set in a task bits and terms, else empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, scheme, seen, none = WordHashes(), Scheme(percent, order), set(), np.zeros(0, np.int64)
        for whole in batches:
            for lo in range(0, len(whole), 500):
                b = whole.iloc[lo : lo + 500]
                sets = sets_of(b["text"], n, words)
                node = [digest(h) if len(h) else None for h in sets]
                bits, listed, enumerated = [], [], []
                for k, h in zip(node, sets):
                    new = k is not None and k not in seen
                    bits.append(bitmap(h) if new else none)
                    listed.append(scheme.listed(h) if new else none)
                    enumerated.append(scheme.enumerated(h) if new else none)
                    if len(seen) > CACHE:
                        seen.clear()
                    seen.add(k)
                yield pd.DataFrame({"doc_id": b["doc_id"], "n_shingles": [len(h) for h in sets], "node": pd.array(node, "Int64"), "bits": bits, "listed": listed, "enumerated": enumerated})

    # ids go as text: pandas would turn them to doubles beside a null
    rows = docs.select(F.col("doc_id").cast("long").cast("string"), F.col("text").cast("binary")).mapInPandas(run, _SETS)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def digest(h: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)


def bitmap(h: np.ndarray) -> np.ndarray:
    """Parity of the members that fall on each bit."""
    bits = 64 * WORDS
    odd = np.bincount((h >> np.uint64(30)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def nameless(docs: DataFrame, n: int) -> DataFrame:
    """node, text (bytes) of the rows without doc_id, whose texts no id can fetch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for b in batches:
            rows = [(digest(h), bytes(t)) for h, t in zip(sets_of(b["text"], n, words), b["text"]) if len(h)]
            yield pd.DataFrame(rows, columns=["node", "text"])

    return docs.where("doc_id is null").select(F.col("text").cast("binary")).mapInPandas(run, "node long, text binary")


def verified(both: DataFrame, n: int, percent: int) -> DataFrame:
    """Of a, b, ta, tb (nodes and texts) the pairs that link, by the exact overlap. A text with another set than its node's is passed over."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, known = WordHashes(), {}

        def members(node: int, text: bytes) -> np.ndarray | None:
            if node not in known:
                h = shingles(bytes(text), n, words)
                if digest(h) != node:
                    return None
                if len(known) >= 200:
                    known.clear()
                known[node] = h
            return known[node]

        for b in batches:
            out = []
            for i, j, ti, tj in zip(b["a"], b["b"], b["ta"], b["tb"]):
                x, y = members(i, ti), members(j, tj)
                if x is not None and y is not None:
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        out.append((i, j))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return both.mapInPandas(run, "a long, b long").distinct()


def boundary(scheme: Scheme, sets: DataFrame, ends: DataFrame) -> int:
    """The size up to which subsets cost fewer terms than the lists, by their measured lengths, have rows to scan."""
    small = sets.where(F.col("n_shingles").between(scheme.least, scheme.most_light))
    terms = small.select("n_shingles", "node", F.explode("listed").alias("key")).distinct()
    rows = terms.join(ends, "key", "left").groupBy("n_shingles").agg(F.sum(F.coalesce("length", F.lit(1))).alias("scan"), F.count_distinct("node").alias("sets")).collect()
    heavy = {r.n_shingles: r.scan for r in rows}  # a row for each of a few sizes; those stay listed that may have a heavy partner
    light = {r.n_shingles: r.sets * scheme.subsets(r.n_shingles) for r in rows}
    cost = lambda x: sum(v for k, v in light.items() if k <= x) + sum(v for k, v in heavy.items() if scheme.largest(k) > x)
    return min(range(scheme.least - 1, scheme.most_light + 1), key=lambda x: (cost(x), x))


def linked(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scheme = Scheme(percent)
    base = Stored(signed(docs, n, percent, rarity(docs, n)))
    rows = Stored(base.df.select("doc_id", "n_shingles", "node")).df
    sets = base.df.where(F.size("bits") > 0)
    terms = lambda which, rows: rows.select(F.explode(which).alias("key"), "node", F.col("n_shingles").cast("int").alias("n"))
    listed = pairs.shared(terms("listed", sets))
    ends = pairs.ends(listed.df.withColumn("copies", F.lit(1)))
    light = boundary(scheme, sets, ends.df)
    if light < scheme.least:
        met = pairs.members(listed.df, ends.df)
    else:
        met = pairs.members(listed.df.where(F.col("n") * 100 >= (light + 1) * percent), ends.df)
    listed.drop()
    ends.drop()
    if light >= scheme.least:
        few = pairs.shared(terms("enumerated", sets.where(F.col("n_shingles") <= light)))
        ends = pairs.ends(few.df.withColumn("copies", F.lit(1)))
        more = pairs.members(few.df, ends.df)
        few.drop()
        ends.drop()
        met = Stored(met.df.unionByName(more.df))
        more.drop()
    needed = Stored(met.df.select("node").distinct())
    feats = Stored(sets.join(needed.df.hint("merge"), "node", "left_semi").select("node", F.col("n_shingles").alias("n"), "bits").dropDuplicates(["node"]))
    base.drop()
    named = Stored(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))).df
    # the texts of nodes in lists, taken out of the documents once; their ids grow with the documents, so both sides are shuffled at any size
    where = Stored(needed.df.join(named, "node").select("node", F.col("least").alias("doc_id")))
    needed.drop()
    held = docs.join(where.df.hint("merge"), "doc_id").select("node", F.col("text").cast("binary").alias("text"))
    lone = nameless(docs, n).join(where.df.where("doc_id is null").select("node"), "node").groupBy("node").agg(F.min("text").alias("text"))
    texts = Stored(held.unionByName(lone))
    where.drop()

    checks = count()

    def verify(met: DataFrame) -> DataFrame:
        ends = met.select(F.col("a").alias("node")).unionByName(met.select(F.col("b").alias("node"))).distinct()
        # the nodes of the first check grow with the documents, those of later ones are few
        part = Stored(texts.df.join(ends if next(checks) else ends.hint("merge"), "node", "left_semi")).df
        one = lambda c: part.select(F.col("node").alias(c), F.col("text").alias("t" + c))
        return verified(met.join(one("a"), "a").join(one("b"), "b"), n, percent)

    own = rows.where("node is not null and doc_id is not null").select("doc_id", "node")
    several = own.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("doc_id", "a")
    same = own.join(several, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    at = pairs.linked(met.df, feats.df, verify, percent, WORDS, same)
    for x in (met, feats, texts):
        x.drop()
    # equal sets are one node; rows without a set stand alone
    rooted = named.join(at, "node", "left").select("node", "least", "rows", F.coalesce("root", "node").alias("root"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("rows").alias("members"))
    ids = rooted.join(best.where("members > 1"), "root").select("node", "component_id")
    return rows.join(ids, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
