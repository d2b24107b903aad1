"""Line dedup: fuzzy lines by MinHash, verified by exact Jaccard, one line per component.

Equal lines fall together by a 128-bit hash. For fuzzy ones, a line's set is its runs of
`WIDTH` characters (UTF-16 units). The signature comes from all of them, the set that is
verified: one 64-bit hash deals the runs to `BANDS * ROWS` bins and the least of each bin is
kept, so a bin of two lines agrees as often as their Jaccard says, or is empty in both.
`BANDS` bands of `ROWS` bins are the keys under which lines meet; with a Jaccard of 0.8
fewer than one pair in a thousand never does. Short lines leave bins empty; a band without
any run is no key. Long lines look for their bins' least hashes among the least of all
first, and among all runs where those leave bins empty (`signatures`). What meets is linked
as pairs.py says: exact bounds, then the exact overlap of the runs. Components are found by
stars (see graph.py); the line with the smallest (doc_id, place) of each component stays,
all others go.

Columns and SQL functions only. Lines are what stands between line feeds. Lines of white
space alone (blank, tab, vertical tab, form feed, carriage return) stay. Rows without doc_id
or text are passed on as they are. Rows that share a doc_id are one document: lines at the
same place are the same line. Of equal lines of one document the first stays. Very long
lines are read whole. Other columns are passed on, whatever their names; `n_gone` alone is
replaced where the input has it.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pairs
from .common import Stored

WIDTH = 8
BANDS, ROWS = 10, 3
BINS = BANDS * ROWS
PER_BIN = 8
FEW = PER_BIN * BINS
HALVES = 2
WORDS = 32
CELLS = 8 * WORDS
LONG = 1 << 18
PERCENT = 80
_BLANK = " \t\x0b\x0c\r"


def visible(line: Column) -> Column:
    return F.trim(line, F.lit(_BLANK)) != ""


def _positions(lines: DataFrame, *keep: str) -> DataFrame:
    """keep, u (the line in UTF-16), n (its runs) and i, the place of each run."""
    n = F.greatest((F.length("u") / 2).cast("int") - (WIDTH - 1), F.lit(1))
    units = lines.select(*keep, F.encode("line", "UTF-16BE").alias("u")).select(*keep, "u", n.alias("n"))
    return units.select(*keep, "u", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))


def runs(lines: DataFrame, *keep: str) -> DataFrame:
    """keep, s: the hash of each run of WIDTH characters of `line`; a shorter line is one run."""
    return _positions(lines, *keep).select(*keep, _hash().alias("s"))


def _hash() -> Column:
    return F.xxhash64(F.substring("u", 2 * F.col("i") - 1, F.lit(2 * WIDTH)))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, place, line, h, g (two hashes) of each line with a visible character."""
    return (
        docs.where(F.col("doc_id").isNotNull())
        .select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
        .where(visible(F.col("line")))
        .withColumn("h", F.xxhash64("line")).withColumn("g", F.xxhash64(F.lit(1), "line"))
    )


def _bands(lines: DataFrame, all_runs: bool) -> DataFrame:
    """h, copies (2^20 at most), many (more than FEW runs), filled (bins with a run) and the bands' keys of each text; all but the first shuffle stays in its task.

    What goes with h is packed into one number with the band, as a hash table of two numbers is quicker than one of four.
    """
    kinds = lines.groupBy("h").agg(F.first("line").alias("line"), F.count("*").alias("copies"))
    hashed = _positions(kinds, "h", "copies").select("h", "copies", "n", "i", _hash().alias("s"))
    many = F.col("n") > FEW
    if not all_runs:
        # long lines: the least hashes, PER_BIN a bin as expected, hold the least of nearly every bin;
        # the first run keeps a line in the table whose least hashes all lie higher
        low = F.expr(f"2L * ((9223372036854775807L div n) * {FEW}L - 4611686018427387904L)")
        hashed = hashed.where(~many | (F.col("i") == 1) | (F.col("s") < F.when(many, low)))
    who = F.least("copies", F.lit(1 << 20)) * 2 + many.cast("long")
    binned = hashed.select("h", who.alias("who"), "s", F.pmod("s", F.lit(BINS)).cast("int").alias("bin"))
    at = F.col("who") * BANDS + F.expr(f"bin div {ROWS}")
    least = [F.min(F.when(F.pmod("bin", F.lit(ROWS)) == r, F.col("s"))).alias(f"m{r}") for r in range(ROWS)]
    bands = binned.groupBy("h", at.alias("at")).agg(*least)
    filled = reduce(add, (F.col(f"m{r}").isNotNull().cast("int") for r in range(ROWS)))
    band = F.pmod("at", F.lit(BANDS)).cast("int").alias("band")
    key = F.xxhash64(band, *[F.coalesce(f"m{r}", F.lit(r).cast("long")) for r in range(ROWS)])
    keys = bands.select("h", F.expr(f"at div {BANDS}").alias("who"), band, filled.alias("filled"), key.alias("key"))
    each = keys.groupBy("h", "who").agg(F.sum("filled").alias("filled"), *[F.max(F.when(F.col("band") == b, F.col("key"))).alias(f"k{b}") for b in range(BANDS)])
    return each.select(
        "h", F.shiftright("who", 1).alias("copies"), (F.pmod("who", F.lit(2)) == 1).alias("many"), "filled",
        F.array_compact(F.array(*[f"k{b}" for b in range(BANDS)])).alias("keys"),
    )


def signatures(lines: DataFrame) -> tuple[Stored, Stored]:
    """h, copies and the keys of a line's bands, in two tables.

    The first pass reads long lines by their least hashes: a bin's least run is the least of all
    its runs where it has one among them. Lines that leave any bin empty so are left to the second pass,
    over all their runs; both give the keys that a full reading gives.
    """
    weak = F.col("many") & (F.col("filled") < BINS)
    seen = Stored(_bands(lines, False))
    first = Stored(seen.df.where(~weak).select("h", "copies", "keys"))
    weak = Stored(seen.df.where(weak).select("h"))
    seen.drop()
    # a line has no more runs than bytes
    long = lines.where(F.octet_length("line") > FEW)
    second = Stored(_bands(long.join(weak.df, "h", "left_semi"), True).select("h", "copies", "keys"))
    weak.drop()
    return first, second


def features(texts: DataFrame) -> DataFrame:
    """node, n, least, bits of each text (h, line): see pairs.py. Texts are dealt by h first, to small parts; the rest stays in its task.

    The runs fall on the cells of 64 * CELLS bits first, where a bit tells whether any does, so
    repeated runs do no harm and need not be taken out. Sets of cells differ in no more
    members than the sets of runs; of them the parity bitmap is made, by folding. n counts all places and
    least the cells, between which the number of different runs lies.
    """
    parts = 4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("s", F.lit(64)).cast("int"))
    hashed = _positions(texts.repartition(parts, "h"), "h").select("h", "n", _hash().alias("s"))
    at = F.col("n").cast("long") * CELLS + F.pmod(F.shiftright("s", 6), F.lit(CELLS))
    cells = hashed.groupBy("h", at.alias("at")).agg(F.bit_or(bit).alias("bits"))
    fold = (F.expr(f"at div {CELLS}") * WORDS + F.pmod("at", F.lit(WORDS))).alias("at")
    words = cells.groupBy("h", fold).agg(F.sum(F.bit_count("bits")).alias("least"), F.bit_xor("bits").alias("bits")).select(
        "h", F.expr(f"at div {WORDS}").alias("n"), F.pmod("at", F.lit(WORDS)).cast("int").alias("word"), "least", "bits"
    )
    of = lambda j: F.coalesce(F.max(F.when(F.col("word") == j, F.col("bits"))), F.lit(0).cast("long"))
    flat = words.groupBy("h", "n").agg(F.sum("least").alias("least"), *[of(j).alias(f"w{j}") for j in range(WORDS)])
    return flat.select(F.col("h").alias("node"), "n", "least", F.array(*[f"w{j}" for j in range(WORDS)]).alias("bits"))


def run_set(u: str, n: str) -> Column:
    """The different hashes of a line's n runs as an array; the line in UTF-16 goes in as a lambda's variable, as a column would be copied once a run."""
    at = F.sequence(F.lit(1), F.col(n))
    hashes = lambda x: F.transform(at, lambda i: F.xxhash64(F.substring(x, 2 * i - 1, F.lit(2 * WIDTH))))
    return F.array_distinct(F.get(F.transform(F.array(u), hashes), F.lit(0)))


def similar(met: DataFrame, texts: DataFrame, percent: int = PERCENT, long: int = LONG) -> DataFrame:
    """Of pairs (a, b) those whose lines (h, line) have the Jaccard asked for, by all runs of both.

    Both sets are made where the pair lies, so no run is a row; where a line has more than
    `long` bytes, runs are rows, as such sets may not fit a task.
    """
    one = lambda c: texts.select(F.col("h").alias(c), F.col("line").alias("l" + c), (F.octet_length("line") > long).alias("far" + c))
    both = met.join(one("a"), "a").join(one("b"), "b")
    far = F.col("fara") | F.col("farb")
    runs_of = lambda c: F.greatest((F.length("u" + c) / 2).cast("int") - (WIDTH - 1), F.lit(1)).alias("n" + c)
    short = both.where(~far).select("a", "b", F.encode("la", "UTF-16BE").alias("ua"), F.encode("lb", "UTF-16BE").alias("ub"))
    short = short.select("a", "b", "ua", "ub", runs_of("a"), runs_of("b"))
    # a step at a time in lambdas, so that each is done once
    sets = F.array(F.struct(run_set("ua", "na").alias("x"), run_set("ub", "nb").alias("y")))
    sizes = F.transform(sets, lambda s: F.struct(F.size(F.array_intersect(s.x, s.y)).alias("common"), (F.size(s.x) + F.size(s.y)).alias("sum")))
    near = short.where(F.exists(sizes, lambda z: 100 * z.common.cast("long") >= percent * (z.sum - z.common).cast("long"))).select("a", "b")
    sides = both.where(far).select("a", "b", F.inline(F.array(F.struct(F.lit(1).alias("side"), F.col("la").alias("line")), F.struct(F.lit(2).alias("side"), F.col("lb").alias("line")))))
    of = runs(sides, "a", "b", "side").groupBy("a", "b", "s").agg(F.bit_or("side").alias("in"))
    count = of.groupBy("a", "b").agg(F.count("*").alias("all"), F.count_if(F.col("in") == 3).alias("common"))
    return near.unionByName(count.where(100 * F.col("common") >= percent * F.col("all")).select("a", "b"))


def fuzzy_components(lines: DataFrame) -> DataFrame:
    """node, root over the hashes of lines that are similar to others."""
    signed = signatures(lines)
    keys = signed[0].df.unionByName(signed[1].df).select(F.explode("keys").alias("key"), F.col("h").alias("node"), "copies")
    # by halves of the keys, so that only half of them lies in shuffle files at once
    halves = [pairs.counted(keys.where(F.pmod("key", F.lit(HALVES)) == i)) for i in range(HALVES)]
    lists = reduce(DataFrame.unionByName, (x.df for x in halves))
    for x in signed:
        x.drop()
    ends = pairs.ends(lists)
    met = pairs.members(lists, ends.df)
    for x in (*halves, ends):
        x.drop()
    needed = Stored(met.df.select(F.col("node").alias("h")).distinct())
    texts = Stored(lines.select("h", "line").join(needed.df, "h", "left_semi").dropDuplicates(["h"]))
    needed.drop()
    feats = Stored(features(texts.df))
    out = pairs.linked(met.df, feats.df, lambda p: similar(p, texts.df), PERCENT, WORDS)
    for x in (met, texts, feats):
        x.drop()
    return out


def dropped(docs: DataFrame) -> DataFrame:
    """doc_id, gone: the places (from 0, rising) of the lines that go; documents that lose none are absent."""
    kept = Stored(lines_of(docs), repeats=False)
    lines = kept.df
    found = fuzzy_components(lines)
    at = found.select(F.col("node").alias("h"), "root").unionByName(found.select(F.col("root").alias("h"), "root").distinct())
    # the second hash tells unequal lines apart, except within a component
    placed = lines.select("doc_id", "place", "h", "g").join(at, "h", "left").select(
        "doc_id", "place", F.coalesce("root", "h").alias("k"), F.when(F.col("root").isNull(), F.col("g")).otherwise(F.lit(0)).alias("g")
    )
    placed = Stored(placed).df
    kept.drop()
    # the least document first, then its least place: a hash table holds numbers, not structs
    first = placed.groupBy("k", "g").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    several = Stored(placed.join(first, ["k", "g"])).df
    stays = several.where("doc_id = first").groupBy("k", "g").agg(F.min("place").alias("stays"))
    gone = several.join(stays, ["k", "g"]).where("doc_id <> first or place <> stays")
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("place")).alias("gone"))


def dedup(docs: DataFrame) -> DataFrame:
    """docs with the lines gone from text, and `n_gone`."""
    own = [c for c in docs.columns if c != "n_gone"]
    gone = dropped(docs.select("doc_id", "text")).select(F.col("doc_id").alias("_id"), F.col("gone").alias("_gone"))
    both = docs.select(F.struct(*own).alias("_row")).join(gone, F.col("_row.doc_id") == F.col("_id"), "left")
    kept = F.array_join(F.filter(F.split("_row.text", "\n", -1), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    text = F.when(F.size("_gone") > 0, kept).otherwise(F.col("_row.text")).alias("text")
    return both.select(*[text if c == "text" else F.col("_row")[c].alias(c) for c in own], F.coalesce(F.array_size("_gone"), F.lit(0)).alias("n_gone"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_kept, gone for each row of docs."""
    rows = docs.select("doc_id", F.coalesce(F.array_size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
    return rows.join(dropped(docs.select("doc_id", "text")), "doc_id", "left").select(
        "doc_id", "n_lines", (F.col("n_lines") - F.coalesce(F.array_size("gone"), F.lit(0))).alias("n_kept"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone")
    )
