"""Ranked lexical search over shards of compressed postings, document at a time.

A shard is a run of documents that one task reads, closed at `SHARD` tokens, so its size doesn't depend on the
table's. Its documents are numbered in the order of doc_id; for each term it holds the numbers
(as gaps) and the occurrences as variable-length bytes. The index has a row for each shard and
term, and one row a shard with its documents' ids and lengths.

Queries are rows too: each term carries the items that hold it and meets the shards' postings by
a join. In each shard a heap merges an item's posting lists by document (k-way); a document's
score is complete when its number leaves the heap, and a bounded heap, keyed by score and then
doc_id, keeps the best. Lists whose highest scores together cannot lift a document into that heap are
left out of the merge and searched for the documents that still can enter; this skips work, not
documents. The shards' best rows are ranked in one window, which holds each task's rows to `k` before they
are shuffled. N, L and df are counted over all shards.

Terms are the maximal runs of characters other than the ASCII ones that are neither letters nor digits; A-Z
are lowered. With w = floor(1000 ln((2N+2)/(2df+1))) and m = 75 + 25nN div L, an item's score
for a document is the sum over its terms, repeats included, of w (10^9 tf div (1000 tf + 12 m)).

Null and empty texts have no terms: such documents count nowhere, such items find nothing. Rows
that share a doc_id are documents of their own; rows without doc_id are ranked with a null one,
after others of their score. Repeated item_ids are one item with all their terms; items
without item_id are passed over. Other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace
from math import floor, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stored, text_id

SHARD = 4_000_000
BLOCK = 256
K = 20
# A-Z lowered; what is neither an ASCII letter or digit nor part of a longer character is a space
_TERMS = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or chr(x).isalnum() else 32 for x in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of nonnegative numbers, seven bits each, the last one of a number below 128; and where each number ends."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1 << 7 * k)
    ends = np.cumsum(size)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        some = size > k
        byte = (v[some] >> np.uint64(7 * k)).astype(np.uint8) & 127
        out[(ends - size)[some] + k] = byte | np.where(size[some] > k + 1, 128, 0).astype(np.uint8)
    return out, ends


def unpacked(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(b < 128)
    if not len(last):
        return np.zeros(0, np.int64)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), first)


class Shard:
    """Documents of one task as they come; `batches` gives the index rows."""

    def __init__(self) -> None:
        self.ids: list[str | None] = []
        self.lengths: list[int] = []
        self.vocabulary: dict[bytes, int] = {}
        self.tokens: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: str | None, terms: list[bytes]) -> None:
        v = self.vocabulary
        self.tokens.append(np.fromiter((v.setdefault(t, len(v)) for t in terms), np.int32, len(terms)))
        self.ids.append(doc_id)
        self.lengths.append(len(terms))
        self.size += len(terms)

    def batches(self, shard: int) -> Iterator[pa.RecordBatch]:
        if not self.ids:
            return
        named = [i is not None for i in self.ids]
        ids, lengths = np.array([int(i or 0) for i in self.ids], np.int64), np.array(self.lengths, np.int64)
        order = np.lexsort((ids, ~np.array(named)))
        number = np.empty(len(ids), np.int64)
        number[order] = np.arange(len(ids))
        # occurrences by term, then document
        pair = np.concatenate(self.tokens).astype(np.int64) * len(ids) + np.repeat(number, lengths)
        pair, tf = np.unique(pair, return_counts=True)
        term, doc = pair // len(ids), pair % len(ids)
        start = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        df = np.diff(np.concatenate([start, [len(term)]]))
        gap = np.diff(doc, prepend=0)
        gap[start] = doc[start]
        (gaps, gap_ends), (counts, count_ends) = packed(gap), packed(tf)
        gaps, counts = gaps.tobytes(), counts.tobytes()
        cut = lambda data, ends: [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        last = start + df - 1
        words = list(self.vocabulary)
        own = [b.decode(errors="replace") for b in words]
        n = len(own)
        fields = [f.split()[0] for f in _INDEX.split(", ")]
        none = pa.nulls(n, pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, shard)), pa.array(own, pa.string()), pa.array(df), pa.nulls(n, pa.int64()), pa.array(cut(gaps, gap_ends[last]), pa.binary()), pa.array(cut(counts, count_ends[last]), pa.binary()), none],
            fields,
        )
        lengths, _ = packed(lengths[order])
        named = np.array(named)[order]
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard]), pa.array([None], pa.string()), pa.array([len(ids)]), pa.array([self.size]), pa.array([ids[order][named].astype("<i8").tobytes()], pa.binary()), pa.array([lengths.tobytes()], pa.binary()), pa.array([np.packbits(named).tobytes()], pa.binary())],
            fields,
        )


# a term's row: df, gaps, counts of occurrences; a shard's own (term null): documents, tokens, ids, lengths, which have ids
_INDEX = "shard long, term string, df long, tokens long, places binary, counts binary, named binary"


def index(docs: DataFrame) -> DataFrame:
    """The rows of `_INDEX` for docs (doc_id, text), in one pass without a shuffle. Write it down before it is searched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, shard = TaskContext.get().partitionId(), 0, Shard()
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                terms = terms_of(t.as_buffer().to_pybytes()) if t.is_valid else []
                if terms:
                    shard.add(i, terms)
                if shard.size >= SHARD:
                    yield from shard.batches(part << 32 | k)
                    k, shard = k + 1, Shard()
        yield from shard.batches(part << 32 | k)

    return docs.select(text_id("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, _INDEX)


def asked(items: DataFrame) -> DataFrame:
    """block, term, items (item_id, how often) for items (item_id, text); a block has `BLOCK` items on average."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, t.decode(errors="replace")) for i, x in zip(b["item_id"], b["text"]) for t in terms_of(bytes(x))]
            yield pd.DataFrame(rows, columns=["item_id", "term"])

    named = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("binary").alias("text"))
    blocks = -(-named.count() // BLOCK) or 1
    counted = named.mapInPandas(run, "item_id long, term string").groupBy("item_id", "term").agg(F.count("*").alias("times"))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block")
    return counted.groupBy(block, "term").agg(F.collect_list(F.struct("item_id", "times")).alias("items"))


def best(lists: list[tuple[list[int], list[int], int]], k: int) -> list[tuple[int, int]]:
    """(score, number) of the k documents with the highest sums above 0, ties to smaller numbers.

    lists: rising document numbers, their scores, the highest of them.
    """
    lists = sorted(lists, key=lambda x: x[2])
    docs, scores = [x[0] for x in lists], [x[1] for x in lists]
    upto = [0]
    for x in lists:
        upto.append(upto[-1] + x[2])
    at = [0] * len(lists)
    first = 0  # lists below it are searched, not merged
    merge = [(d[0], i) for i, d in enumerate(docs) if d]
    heapify(merge)
    kept: list[tuple[int, int]] = []
    floor_ = 0
    while merge:
        d, score = merge[0][0], 0
        while merge and merge[0][0] == d:
            i = merge[0][1]
            if i < first:
                heappop(merge)
                continue
            p = at[i]
            score += scores[i][p]
            at[i] = p = p + 1
            if p < len(docs[i]):
                heapreplace(merge, (docs[i][p], i))
            else:
                heappop(merge)
        for i in range(first - 1, -1, -1):
            if score + upto[i + 1] <= floor_:
                break
            own = docs[i]
            at[i] = p = bisect_left(own, d, at[i])
            if p < len(own) and own[p] == d:
                score += scores[i][p]
        # documents come by rising number, so one with the floor's own score is too late
        if score <= floor_:
            continue
        if len(kept) < k:
            heappush(kept, (score, -d))
        else:
            heapreplace(kept, (score, -d))
        if len(kept) == k:
            floor_ = kept[0][0]
            while first < len(lists) and upto[first + 1] <= floor_:
                first += 1
    return [(s, -d) for s, d in sorted(kept, reverse=True)]


def search(index: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score of each item's k best documents; items: item_id, text."""
    wanted = Stored(asked(items)).df
    hits = Stored(index.where("term is not null").join(wanted, "term").select("shard", "block", "term", "df", "places", "counts", "items"))
    shards = index.where("term is null")
    n, tokens = shards.agg(F.sum("df"), F.sum("tokens")).first()
    n, tokens = n or 0, tokens or 1
    each = hits.df.select("shard", "term", "df").distinct().groupBy("term").agg(F.sum("df").alias("total"))
    weighed = hits.df.join(each, "term")
    needed = hits.df.select("shard", "block").distinct().join(shards, "shard").select(F.col("shard").alias("of"), F.col("block").alias("asked"), F.col("places").alias("ids"), F.col("counts").alias("lengths"), "named")

    def run(found: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        lengths = unpacked(bytes(own["lengths"].iloc[0]))
        named = np.unpackbits(np.frombuffer(bytes(own["named"].iloc[0]), np.uint8), count=len(lengths)).astype(bool)
        ids = np.frombuffer(bytes(own["ids"].iloc[0]), "<i8").tolist()
        m = 75 + np.array([25 * x * n // tokens for x in lengths.tolist()], np.int64)
        lists: dict[int, list] = {}
        for gaps, counts, total, users in zip(found["places"], found["counts"], found["total"], found["items"]):
            docs, tf = np.cumsum(unpacked(bytes(gaps))), unpacked(bytes(counts))
            w = floor(1000 * log((2 * n + 2) / (2 * total + 1)))
            score = w * (1_000_000_000 * tf // (1000 * tf + 12 * m[docs]))
            docs, score = docs.tolist(), score.tolist()
            for user in users:
                own_score = score if user["times"] == 1 else [user["times"] * x for x in score]
                lists.setdefault(int(user["item_id"]), []).append((docs, own_score, max(own_score)))
        out = [(i, str(ids[d]) if named[d] else None, s) for i, own_lists in lists.items() for s, d in best(own_lists, k)]
        return pd.DataFrame(out, columns=["item_id", "doc_id", "score"])

    found = weighed.groupBy("shard", "block").cogroup(needed.groupBy("of", "asked")).applyInPandas(run, "item_id long, doc_id string, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank_all(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """Index docs, write the index to the shared folder, search it for all items."""
    return search(Stored(index(docs)).df, items, k)


def oracle_sql(k: int = K) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    split = f"unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term"
    return f"""
WITH w AS (SELECT doc_id, {split} FROM documents),
t AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY ALL),
a AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS l FROM d),
f AS (SELECT term, CAST(floor(1000 * ln((2 * max(big_n) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, a GROUP BY ALL),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {split} FROM benchmark) GROUP BY ALL),
s AS (
    SELECT item_id, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // l)))) AS BIGINT) AS score
    FROM q JOIN f USING (term) JOIN t USING (term) JOIN d USING (doc_id), a GROUP BY ALL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= {k}
"""
