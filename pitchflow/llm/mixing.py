"""Mixing sources to target weights: soft membership and nonnegative document rates.

A naive Bayes classifier over `SLOTS` hashed words is counted from at most `TRAIN_ROWS`
documents that the labelled table names and whose domain is known. It gives each document
a posterior over the domains, tempered as if it had `TEMPER` words. Rates r >= 0 are then
fitted by projected least squares so that the expected tokens of each domain,
sum(r * tokens * posterior), meet the targets times all tokens within `CLOSE`. A document's
rate is 1 moved by its posterior times one weight a domain and clipped at 0. A step changes
the weights by the residuals, preconditioned by the second moments of the documents not
clipped, so that small domains move as fast as large ones; it is halved until the objective
falls. Each is one aggregation. Targets that no rates meet end at the least squares and a
warning with the residuals; a fit that ends at neither in `STEPS` aggregations raises.

Sums are of decimals, so results do not depend on their order. Columns and SQL
functions only. Domains are those of the targets; labelled documents of others are left
out of training. Null and empty texts have no tokens, the prior as posterior and rate 1.
Rows with one doc_id are one document: its words add up and its rows share the rate; rows
without doc_id are left out. Without labelled rows every posterior is the uniform one.
Other columns are passed over.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored

TRAIN_ROWS = 20_000
SLOTS = 1024
TEMPER = 24
STEPS = 40
CLOSE = 2e-4
RIDGE = 1e-7
TARGETS = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), lambda x: x != "")


def _slot(word: Column) -> Column:
    return F.when(word.isNotNull(), F.pmod(F.xxhash64(word), F.lit(SLOTS)).cast("int"))


def train(docs: DataFrame, labels: DataFrame, domains: list[str], column: str) -> tuple[list[float], dict[str, list[float]]]:
    """(log prior, log likelihood by slot) of each domain."""
    ids = labels.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    rows = docs.where(F.col(column).isin(domains)).select("doc_id", F.col(column).alias("d"), "text").join(F.broadcast(ids), "doc_id")
    words = rows.select("d", F.explode_outer(_words(F.col("text"))).alias("w")).select("d", _slot(F.col("w")).alias("s"))
    counts = {k: [0] * SLOTS for k in domains}
    for r in words.where("s is not null").groupBy("d", "s").count().collect():
        counts[r.d][r.s] = r["count"]
    many = {r.d: r["count"] for r in rows.groupBy("d").count().collect()}
    prior = [math.log((many.get(k, 0) + 1) / (sum(many.values()) + len(domains))) for k in domains]
    return prior, {k: [math.log((c + 0.5) / (sum(v) + 0.5 * SLOTS)) for c in v] for k, v in counts.items()}


def members(docs: DataFrame, model: tuple[list[float], dict[str, list[float]]], domains: list[str]) -> DataFrame:
    """doc_id, n_tokens, p0, p1, ... for each doc_id."""
    prior, likely = model
    words = docs.where("doc_id is not null").select("doc_id", F.explode_outer(_words(F.col("text"))).alias("w"))
    slot = words.select("doc_id", (_slot(F.col("w")) + 1).alias("s"))
    # whole millionths, so that the sums are exact
    tables = [F.array(*[F.lit(round(x * 1e6)).cast("long") for x in likely[k]]) for k in domains]
    sums = slot.groupBy("doc_id").agg(F.count("s").alias("n_tokens"), *[F.sum(F.element_at(t, F.col("s"))).alias(f"l{i}") for i, t in enumerate(tables)])
    pace = F.lit(1e-6) * F.lit(float(TEMPER)) / F.greatest(F.col("n_tokens"), F.lit(TEMPER))
    z = [F.lit(prior[i]) + F.coalesce(F.col(f"l{i}"), F.lit(0)) * pace for i in range(len(domains))]
    scored = sums.select("doc_id", "n_tokens", *[c.alias(f"z{i}") for i, c in enumerate(z)])
    top = F.greatest(*[F.col(f"z{i}") for i in range(len(domains))]) if len(domains) > 1 else F.col("z0")
    e = scored.select("doc_id", "n_tokens", *[F.exp(F.col(f"z{i}") - top).alias(f"e{i}") for i in range(len(domains))])
    whole = sum((F.col(f"e{i}") for i in range(len(domains))), F.lit(0.0))
    return e.select("doc_id", "n_tokens", *[(F.col(f"e{i}") / whole).alias(f"p{i}") for i in range(len(domains))])


def _solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Gaussian elimination with pivots."""
    rows = [[*row, x] for row, x in zip(matrix, right)]
    for k in range(len(rows)):
        best = max(range(k, len(rows)), key=lambda i: abs(rows[i][k]))
        rows[k], rows[best] = rows[best], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        rows = [row if i == k else [x - row[k] * y for x, y in zip(row, rows[k])] for i, row in enumerate(rows)]
    return [row[-1] for row in rows]


def fit(soft: DataFrame, targets: list[float], steps: int = STEPS) -> DataFrame:
    """soft with `rate`; soft: n_tokens and the posteriors p0, p1, ..."""
    n = len(targets)
    goal = [t / sum(targets) for t in targets]
    exact = lambda x: F.sum(x.cast("decimal(28,6)"))
    at = Stored(soft).df
    total = at.agg(F.sum("n_tokens").alias("all")).first()["all"]
    if not total:
        return at.withColumn("rate", F.lit(1.0))
    rate = lambda v: F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.lit(x) * F.col(f"p{i}") for i, x in enumerate(v)), F.lit(0.0)))

    def measure(v: list[float]) -> tuple[float, list[float], list[float], list[list[float]]]:
        """Objective, residuals, its descent and its second derivatives at weights v."""
        w = at.withColumn("rate", rate(v)).withColumn("live", F.when(F.col("rate") > 0, F.col("n_tokens")).otherwise(0))
        sums = w.agg(
            exact(F.col("n_tokens") * F.col("rate") * F.col("rate")).alias("q"),
            *[exact(F.col("n_tokens") * F.col("rate") * F.col(f"p{i}")).alias(f"t{i}") for i in range(n)],
            *[exact(F.col("live") * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"g{i}_{j}") for i in range(n) for j in range(i + 1)],
        ).first()
        of = lambda name: float(sums[name] or 0) / total
        off = [of(f"t{i}") - goal[i] for i in range(n)]
        second = [[of(f"g{max(i, j)}_{min(i, j)}") + (RIDGE if i == j else 0) for j in range(n)] for i in range(n)]
        value = of("q") / 2 + sum(g * x + RIDGE / 2 * x * x for g, x in zip(goal, v))
        return value, off, [o - RIDGE * x for o, x in zip(off, v)], second

    v, size = [0.0] * n, 1.0
    value, off, down, second = measure(v)
    move = _solve(second, down)
    for _ in range(steps):
        if max(map(abs, off)) < CLOSE:
            return at.withColumn("rate", rate(v))
        if max(map(abs, down)) < CLOSE / 20:
            warnings.warn(f"no rates meet the targets; residuals of the nearest: {[round(x, 6) for x in off]}", RuntimeWarning, stacklevel=2)
            return at.withColumn("rate", rate(v))
        tried = [x + size * y for x, y in zip(v, move)]
        found = measure(tried)
        if found[0] <= value - 1e-4 * size * sum(a * b for a, b in zip(down, move)) or max(map(abs, found[2])) < max(map(abs, down)) / 2:
            v, size = tried, 1.0
            value, off, down, second = found
            move = _solve(second, down)
        else:
            size /= 2
    if max(map(abs, off)) < CLOSE:
        return at.withColumn("rate", rate(v))
    # every step lowered the objective, so the last rates are the nearest of those seen
    warnings.warn(f"rates not within {CLOSE} of the targets after {steps} steps; residuals {[round(x, 6) for x in off]}", RuntimeWarning, stacklevel=2)
    return at.withColumn("rate", rate(v))


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, column: str = "lang") -> DataFrame:
    """doc_id, n_tokens, rate, p_<domain>... for each doc_id of docs (doc_id, text and the domain column)."""
    domains = sorted(targets)
    soft = members(docs, train(docs, labels, domains, column), domains)
    fitted = fit(soft, [targets[k] for k in domains])
    rate = F.when(F.col("n_tokens") == 0, 1.0).otherwise(F.round("rate", 6))
    return fitted.select("doc_id", "n_tokens", rate.alias("rate"), *[F.round(f"p{i}", 6).alias(f"p_{k}") for i, k in enumerate(domains)])


def copies(rate: Column, doc_id: Column) -> Column:
    """A whole number whose expectation is the rate: the rest is decided by the id's hash."""
    chance = F.pmod(F.xxhash64(doc_id, F.lit(9)), F.lit(1_000_000)) / 1_000_000
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("int")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, column: str = "lang") -> DataFrame:
    """docs with each row as many times as its rate says; rows without doc_id stay once. Other columns may have any name."""
    fitted = rates(docs.select("doc_id", "text", column), labels, targets, column)
    times = fitted.select(F.col("doc_id").alias("_id"), copies(F.col("rate"), F.col("doc_id")).alias("_times"))
    rows = docs.select(F.struct(*docs.columns).alias("_row")).join(times, F.col("_row.doc_id") == F.col("_id"), "left")
    return rows.select(F.inline(F.array_repeat("_row", F.coalesce("_times", F.lit(1)))))
