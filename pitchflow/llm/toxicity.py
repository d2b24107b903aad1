"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence has p = sigmoid(bias + sum of its words' weights); a document has
1 - (1 - LEAK) * prod(1 - p), the noisy-or of its sentences. The weights are learnt from
document labels alone, by the gradient of the bag likelihood, on the driver from at most
`TRAIN_ROWS` labelled documents (a documented bound; the rows with the smallest hashes of
doc_id). The sentences with a p of `SPAN` or more are the located ones.

Null and empty texts have no sentence and score LEAK. Without labelled rows of both
classes every text scores LEAK. Repeated rows score alike, each for itself. Very long texts
are scored whole. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import exact_ids, labelled_sample, text_id

TRAIN_ROWS = 5000
LEAK = 0.002
SPAN = 0.3
THRESHOLD = 0.3
TELLING = 12.0

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _SENTENCE.finditer(text)]


def telling(toxic: int, docs: int, rate: float) -> bool:
    """Whether a word stands in more toxic documents than chance gives (Chernoff's bound on the tail)."""
    share = toxic / docs
    if share <= rate:
        return False
    gap = share * math.log(share / rate) + (share < 1 and (1 - share) * math.log((1 - share) / (1 - rate)))
    return docs * gap > TELLING


class BagModel:
    def __init__(self) -> None:
        self.weight: dict[str, float] = {}
        self.bias = -30.0

    def fit(self, bags: list[tuple[str, int]], rounds: int = 200, ridge: float = 2e-4) -> BagModel:
        if len({y for _, y in bags}) < 2:
            return self
        # two passes over the texts, so that no more than the kept words are held
        found, bad = Counter(), Counter()
        for text, y in bags:
            words = set(_WORD.findall(text.lower()))
            found.update(words)
            if y:
                bad.update(words)
        rate = sum(y for _, y in bags) / len(bags)
        vocabulary = {w: i for i, w in enumerate(sorted(w for w, t in bad.items() if telling(t, found[w], rate)))}
        del found, bad
        item, sent, owner = array("i"), array("i"), array("i")
        n = 0
        for d, (text, _) in enumerate(bags):
            for m in _SENTENCE.finditer(text.lower()):
                words = set(_WORD.findall(m[0]))
                if words:
                    at = [vocabulary[w] for w in words if w in vocabulary]
                    item.extend(at)
                    sent.extend([n] * len(at))
                    owner.append(d)
                    n += 1
        labels = [y for _, y in bags]
        item, sent, owner, y = np.array(item), np.array(sent), np.array(owner), np.array(labels, float)
        w, b = np.zeros(len(vocabulary)), -4.0
        gw2, gb2 = np.full(len(w), 1e-8), 1e-8
        scale = 1 / len(y)
        for _ in range(rounds):
            z = b + np.bincount(sent, w[item], n)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            log_no = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)) + np.log1p(-LEAK)
            P = -np.expm1(log_no)
            # d log-likelihood / dz: negative bags -p; positive bags p (1 - P) / P
            up = np.where(y == 1, (1 - P) / np.maximum(P, 1e-9), -1.0) * scale
            gz = up[owner] * p
            gw = np.bincount(item, gz[sent], len(w)) - ridge * w / len(y) - 1e-6 * np.sign(w)
            gb = gz.sum()
            gw2 += gw * gw
            gb2 += gb * gb
            w += 0.5 * gw / np.sqrt(gw2)
            b += 0.5 * gb / np.sqrt(gb2)
        self.bias = float(b)
        self.weight = {t: float(w[i]) for t, i in vocabulary.items() if abs(w[i]) > 1e-3}
        return self

    def spans(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The text's score, and (start, end, p) of its located sentences."""
        get, no, out = self.weight.get, 1 - LEAK, []
        low = text.lower()
        if len(low) != len(text):  # a few letters change their length
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        for m in _SENTENCE.finditer(low):
            z = self.bias + sum(get(w, 0.0) for w in set(_WORD.findall(m[0])))
            if z > -30:
                p = 1 / (1 + np.exp(-z)) if z < 30 else 1.0
                no *= 1 - p
                if p >= SPAN:
                    out.append((*m.span(), float(p)))
        return float(min(1.0, max(0.0, 1 - no))), out


def train(docs: DataFrame, labels: DataFrame) -> BagModel:
    return BagModel().fit([(t.decode("utf-8", "replace"), y) for t, y in labelled_sample(docs, labels, "toxic", TRAIN_ROWS)])


def held_out(doc_id: Column) -> Column:
    """The rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


SCHEMA = "doc_id string, score double, n_sentences long, spans array<struct<start:int,end:int,p:double>>"


def score(docs: DataFrame, model: BagModel) -> DataFrame:
    """Score and located sentences for each row of docs (doc_id, text); no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [model.spans(t or "") for t in b["text"]]
            yield pd.DataFrame({
                "doc_id": b["doc_id"],
                "score": [x for x, _ in found],
                "n_sentences": [len(s) for _, s in found],
                "spans": [[{"start": i, "end": j, "p": p} for i, j, p in s] for _, s in found],
            })

    return exact_ids(docs.select(text_id("doc_id"), "text").mapInPandas(run, SCHEMA), "doc_id")
