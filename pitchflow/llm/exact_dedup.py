"""Exact dedup: texts against a minimal perfect hash over the distinct digests of history.

History is dealt by digest into buckets of about `BUCKET` digests. A bucket's index is a
minimal perfect hash: levels of bits in which a digest that falls on a place alone is set;
the number of set bits before it is its slot, so n digests have slots 0 to n - 1. A slot holds
the full SHA-256 of its text, the locator of the row that stays and how many rows it stands for.

A batch is looked up by its distinct digests (counted before the shuffle, so a text that a third of
the rows hold is a row a task). What the hash answers for a digest counts only where all 32 bytes in
the slot are the same: then the slot takes the batch's rows in, and its winner changes if
theirs is larger. Digests that are no members are grouped by themselves and come into the index
with `absorb`.

Of equal texts the row with the largest doc_id stays; of rows that share it too, one, the last in
the table's own order. A row without doc_id stays only where no row of its text has one. A null
text is an empty one. Columns other than doc_id and text are not looked at; an empty table or
history gives no rows and no members.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored

BUCKET = 100_000
LEVELS = 200
GAMMA = 2
_M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class PerfectHash:
    """Slots 0 to n - 1 for n distinct digests (rows of 32 bytes); -1 or any slot for others."""

    def __init__(self, sizes: Iterable[int], bits: bytes):
        self.sizes = list(sizes)
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8), count=sum(self.sizes), bitorder="little").astype(bool)
        self.before = np.concatenate([[0], np.cumsum(self.bits)])

    @staticmethod
    def place(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        w = np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)
        h = (w[:, level % 4] ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1)) * _M2
        h = (h ^ (h >> np.uint64(29))) * _M3
        return ((h ^ (h >> np.uint64(32))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        sizes, bits, rest = [], [], digests
        while len(rest):
            if len(sizes) == LEVELS:
                raise ValueError("the digests are not distinct")
            size = GAMMA * len(rest) + 1
            at = cls.place(rest, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            rest = rest[~alone[at]]
        return cls(sizes, np.packbits(np.concatenate(bits), bitorder="little").tobytes() if bits else b"")

    def packed(self) -> bytes:
        return np.packbits(self.bits, bitorder="little").tobytes()

    def slots(self, digests: np.ndarray) -> np.ndarray:
        out = np.full(len(digests), -1, np.int64)
        left, start = np.arange(len(digests)), 0
        for level, size in enumerate(self.sizes):
            at = start + self.place(digests[left], level, size)
            hit = self.bits[at]
            out[left[hit]] = self.before[at[hit]]
            left, start = left[~hit], start + size
        return out


def located(docs: DataFrame) -> DataFrame:
    """doc_id, row (its place in the table), digest of each row of docs (doc_id, text)."""
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), digest.alias("digest"))


def bucket(buckets: int) -> Column:
    """By the first 48 bits of the digest, as a whole number."""
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long"), F.lit(buckets))


def groups(rows: DataFrame) -> DataFrame:
    """digest, named, id, row (the winner: has a doc_id, which one, where), n of each distinct digest of rows."""
    winner = F.max(F.struct(F.col("doc_id").isNotNull().cast("int").alias("named"), F.coalesce("doc_id", F.lit(0)).alias("id"), "row"))
    return rows.groupBy("digest").agg(winner.alias("w"), F.count("*").alias("n")).select("digest", "w.named", "w.id", "w.row", "n")


_INDEX = "bucket long, sizes array<long>, bits binary, digests binary, named binary, ids binary, rows binary, counts binary"
_GROUP = "digest binary, named int, id long, row long, n long"


def _digests(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), np.uint8).reshape(-1, 32)


def _slots(k: int, g: pd.DataFrame) -> pd.DataFrame:
    """A bucket's index row out of its groups."""
    if g.empty:
        return pd.DataFrame(columns=[c.split()[0] for c in _INDEX.split(", ")])
    digests = _digests(g["digest"])
    mph = PerfectHash.build(digests)
    order = np.argsort(mph.slots(digests))
    held = [g[c].to_numpy()[order].astype(kind).tobytes() for c, kind in (("named", "<i4"), ("id", "<i8"), ("row", "<i8"), ("n", "<i8"))]
    return pd.DataFrame([[k, mph.sizes, mph.packed(), digests[order].tobytes(), *held]], columns=[c.split()[0] for c in _INDEX.split(", ")])


def _held(r) -> pd.DataFrame:  # noqa: ANN001
    """An index row's slots in order, but the digests."""
    kinds = (("named", r.named, "<i4"), ("id", r.ids, "<i8"), ("row", r.rows, "<i8"), ("n", r.counts, "<i8"))
    return pd.DataFrame({c: np.frombuffer(b, kind).astype(kind[1:]) for c, b, kind in kinds})


def build(history: DataFrame, buckets: int) -> DataFrame:
    """The index of history (groups of distinct digests): a row a bucket."""
    return history.withColumn("bucket", bucket(buckets)).groupBy("bucket").applyInPandas(lambda k, g: _slots(int(k[0]), g), _INDEX)


def look_up(index: DataFrame, batch: DataFrame, buckets: int) -> DataFrame:
    """The groups of index and batch after the batch: digest, named, id, row, n, and whether history held the digest."""

    def run(k: tuple, held: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        columns = ["digest", "named", "id", "row", "n"]
        if held.empty:
            return new[columns].assign(member=False)
        r = held.iloc[0]
        slots, old = _held(r), np.frombuffer(bytes(r.digests), np.uint8).reshape(-1, 32)
        if len(new):
            mine = _digests(new["digest"])
            at = PerfectHash(r.sizes, bytes(r.bits)).slots(mine)
            same = (at >= 0) & (old[np.maximum(at, 0)] == mine).all(1)
            at, hits = at[same], new[same]
            if len(hits):
                n = slots["n"].to_numpy().copy()
                n[at] += hits["n"].to_numpy()  # digests of the batch are distinct, so no slot comes twice
                was, comes = (list(zip(*(f[c].tolist() for c in ("named", "id", "row")))) for f in (slots.iloc[at], hits))
                best = pd.DataFrame([max(a, b) for a, b in zip(was, comes)], columns=["named", "id", "row"])
                for c in best:
                    slots[c] = slots[c].to_numpy().copy()
                    slots.loc[at, c] = best[c].to_numpy()
                slots["n"] = n
            new = new[~same]
        slots.insert(0, "digest", [d.tobytes() for d in old])
        return pd.concat([slots[columns].assign(member=True), new[columns].assign(member=False)])

    new = batch.withColumn("bucket", bucket(buckets))
    return index.groupBy("bucket").cogroup(new.groupBy("bucket")).applyInPandas(run, _GROUP + ", member boolean")


def absorb(index: DataFrame, batch: DataFrame, buckets: int) -> DataFrame:
    """The index after the batch, for the next one."""
    return build(look_up(index, batch, buckets).drop("member"), buckets)


def split(rows: DataFrame) -> Column:
    """Whether a row is of history: its doc_id is in the lower half of the range of ids, or it has none."""
    lo, hi = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    return F.lit(True) if lo is None else F.coalesce(F.col("doc_id") <= lo + (hi - lo) // 2, F.lit(True))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, in_history for each row of docs (doc_id, text).

    The half of the table with the lower ids is history, the rest comes as a batch against it.
    in_history tells whether history held the row's text.
    """
    rows = Stored(located(docs)).df
    old = split(rows)
    history = Stored(groups(rows.where(old)))
    batch = Stored(groups(rows.where(~old)))
    buckets = -(-(history.df.count() + batch.df.count()) // BUCKET) or 1
    index = Stored(build(history.df, buckets))
    after = look_up(index.df, batch.df, buckets).select("digest", F.when(F.col("named") == 1, F.col("id")).alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size"), "member")
    return rows.join(after.hint("merge"), "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), F.col("member").alias("in_history"),
    )


def oracle_sql() -> str:
    return """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
h AS (SELECT min(doc_id) + (max(doc_id) - min(doc_id)) // 2 AS mid FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
    doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256,
    min(doc_id) OVER (PARTITION BY t) <= mid AS in_history
FROM d, h
"""
