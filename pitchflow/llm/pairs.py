"""Similar sets out of lists: stars first, then what is still apart, each pair behind exact bounds.

A list is a key and its nodes; a node is a set with its size and a parity bitmap: bit k
tells whether an odd number of the set's members fall on k. The bits in which two bitmaps
differ are at most the members in which the sets differ, so a pair that differs in more
bits than its Jaccard allows is ruled out for certain, as is one whose sizes are too far
apart. A size may be given by what it is at most (n) and at least (least). What passes goes on
to a check of the sets themselves.

A list is not turned into its pairs. First each node is held against the most copied node
of one of its lists, then against those of its other lists that are in other components, then,
for `TURNS` turns, where a list of three or more still has several components, against one more
by chance. Where it has several even then, the nodes outside the first one's
component are held against the others in the join itself: only pairs of
different components that pass the bounds leave it; of them a node's nearest one is checked first. No list or partner is left out. That join
has no partitioning of its own, so that adaptive execution can split a long list.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored
from .graph import components

TURNS = 2


def differing(words: int) -> Column:
    """The bits in which the bitmaps of a and b differ."""
    return reduce(add, (F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(words)))


def bounds(percent: int, words: int) -> Column:
    """Whether sizes and bitmaps of so many longs allow a Jaccard of percent / 100, over the columns `spread` makes for a and b."""
    apart = differing(words)
    return (100 * F.col("na") >= percent * F.col("lb")) & (100 * F.col("nb") >= percent * F.col("la")) & ((100 + percent) * apart <= (100 - percent) * (F.col("na") + F.col("nb")))


def spread(feats: DataFrame, words: int, c: str, *more: Column) -> DataFrame:
    """feats (node, n, bits and, where n is only what it is at most, least) with columns of their own for side c, as arrays are slow to take apart once a pair."""
    least = "least" if "least" in feats.columns else "n"
    bits = [F.coalesce(F.get("bits", F.lit(i)), F.lit(0).cast("long")).alias(f"{c}{i}") for i in range(words)]
    return feats.select(F.col("node").alias(c), *[F.coalesce(x, F.lit(0).cast("long")).alias(y + c) for x, y in (("n", "n"), (least, "l"))], *bits, *more)


def shared(lists: DataFrame) -> Stored:
    """The rows (key, node and what else a node has) of keys with several nodes, once each. Most keys have one: two numbers a key tell, before anything else is shuffled."""
    several = lists.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("key")
    return Stored(lists.join(several, "key", "left_semi").groupBy("key", "node").agg(*[F.max(c).alias(c) for c in lists.columns if c not in ("key", "node")]))


def counted(lists: DataFrame) -> Stored:
    """As `shared`, for lists in which a node has one row a key: one shuffle, and the rows of a key are counted where they lie."""
    return Stored(lists.withColumn("length", F.count("*").over(Window.partitionBy("key"))).where("length > 1").drop("length"))


def ends(lists: DataFrame) -> Stored:
    """key, lo, length of the keys with several nodes; lists: key, node, copies. lo is the node with the most copies.

    Of keys with the very same nodes one is kept: they are told alike by length, lo and the
    sums of both halves of the nodes' hashes.
    """
    most = F.call_function("shiftleft", F.least("copies", F.lit(1 << 20)).cast("long"), F.lit(42)) + F.pmod("node", F.lit(1 << 42))
    digest = F.xxhash64("node")
    found = lists.groupBy("key").agg(
        F.max_by("node", most).alias("lo"), F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("length"),
        F.sum(digest.bitwiseAND(0xFFFFFFFF)).alias("s"), F.sum(F.shiftrightunsigned(digest, 32)).alias("t"),
    )
    return Stored(found.where("a < b").groupBy("lo", "length", "s", "t").agg(F.min("key").alias("key")).select("key", "lo", "length"))


def members(lists: DataFrame, ends: DataFrame) -> Stored:
    """key, node, lo of those keys' rows, a node once a key."""
    return Stored(lists.select("key", "node").join(ends.select("key", "lo"), "key").distinct().select("key", "node", "lo"))


def linked(met: DataFrame, feats: DataFrame, verify: Callable[[DataFrame], DataFrame], percent: int, words: int, more: DataFrame | None = None) -> DataFrame:
    """node, root over the nodes that link, roots left out; met: key, node, lo; feats: node, n, bits.

    `verify` gives the linking ones of pairs (a, b). `more` are edges known beforehand.
    """
    fit = bounds(percent, words)

    def checked(found: DataFrame) -> DataFrame:
        near = Stored(found.distinct().join(spread(feats, words, "b"), "b").join(spread(feats, words, "a"), "a").where(fit).select("a", "b"))
        links = near.df if near.df.isEmpty() else Stored(verify(near.df)).df
        if links is near.df:
            return links
        near.drop()
        return links

    def rooted(met: DataFrame, at: DataFrame) -> DataFrame:
        """met with the components of node and of lo."""
        home = at.select(F.col("node").alias("lo"), F.col("root").alias("home"))
        both = met.join(at.select("node", "root"), "node", "left").join(home, "lo", "left")
        return both.select("key", "node", "lo", F.coalesce("root", "node").alias("root"), F.coalesce("home", "lo").alias("home"))

    # one lo a node, by an order all nodes share; the others' turn comes where these links do not join them
    best = Stored(met.where("node <> lo").groupBy("node").agg(F.min("lo").alias("best")))
    links = checked(best.df.select(F.col("best").alias("a"), F.col("node").alias("b")))
    at = components(links if more is None else links.unionByName(more))
    others = rooted(met, at).where("root <> home").join(best.df, "node").where("lo <> best")
    at = carried_on(at, checked(others.select(F.col("lo").alias("a"), F.col("node").alias("b"))))
    best.drop()
    for turn in range(TURNS):
        # another node of each list that is still apart, by chance, against those of other components;
        # another one in each list, as lists of a large group are many and have most of their nodes in common;
        # the one pair of a list of two is checked by now
        known = Stored(rooted(met, at))
        order = F.xxhash64("node", "key", F.lit(turn))
        heads = known.df.groupBy("key").agg(
            F.min_by("node", order).alias("a"), F.min_by("root", order).alias("ra"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("length")
        )
        open_ = Stored(known.df.join(heads.where("length > 2 and r0 < r1").select("key", "a", "ra"), "key"))
        known.drop()
        met = open_.df.select("key", "node", "lo")
        # what is held against lo is checked by now
        at = carried_on(at, checked(open_.df.where("root <> ra and node <> lo and a <> lo").select("a", F.col("node").alias("b"))))
    known = rooted(met, at)
    known = Stored(known)
    apart = known.df.where("root <> home").select("key").distinct()
    # pairs with lo are checked by now
    live = Stored(known.df.where("node <> lo").join(apart, "key", "left_semi").join(feats, "node"))
    known.drop()
    # a pair leaves the join in the first of the lists in which it meets
    keys = live.df.groupBy("node").agg(F.collect_set("key").alias("keys"))
    rows = live.df.join(keys, "node")
    a = spread(rows.where("root <> home"), words, "a", F.col("key"), F.col("root").alias("ra"), F.col("keys").alias("ka"))
    b = spread(rows, words, "b", F.col("key"), F.col("root").alias("rb"), F.col("home"), F.col("keys").alias("kb"))
    once = F.array_min(F.array_intersect("ka", "kb")) == F.col("key")
    other = (F.col("ra") != F.col("rb")) & ((F.col("rb") == F.col("home")) | (F.col("a") < F.col("b")))
    rest = Stored(a.join(b.hint("merge"), "key").where(other & fit & once).select("a", "b", differing(words).alias("apart")))
    live.drop()
    for _ in range(TURNS):
        # the nearest by bitmap first; what its link joins needs no further check
        if rest.df.isEmpty():
            break
        nearest = Stored(rest.df.groupBy("a").agg(F.min_by("b", "apart").alias("b")))
        at = carried_on(at, Stored(verify(nearest.df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())).df)
        of = lambda c: at.select(F.col("node").alias(c), F.col("root").alias("r" + c))
        apart = rest.df.join(nearest.df.hint("merge"), ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
        last, rest = rest, Stored(apart.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b", "apart"))
        last.drop()
        nearest.drop()
    late = rest.df if rest.df.isEmpty() else Stored(verify(rest.df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())).df
    return carried_on(at, late)


def carried_on(at: DataFrame, links: DataFrame) -> DataFrame:
    """node, root as in `at`, with the components joined that new links (a, b) connect; only roots go through the stars again."""
    if links.isEmpty():
        return at
    of = lambda c: at.select(F.col("node").alias(c), F.col("root").alias("r" + c))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    moved = components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    to = moved.select(F.col("node").alias("root"), F.col("root").alias("to"))
    rest = at.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return Stored(rest.unionByName(moved)).df
