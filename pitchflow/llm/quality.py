"""Quality rules: a linear-chain CRF marks the lines of a text as content or boilerplate.

Base counts come first (see `base_counts`). A text that passes the base rules is kept when
the words on lines that Viterbi decoding marks as content are at least `CONTENT_SHARE` of
its words. The CRF has two states, real-valued line features, transition weights and start
weights; it is trained on the driver from at most `TRAIN_ROWS` labelled documents, cut to
chains of `RUN` lines: their label stands for each of their lines, and good documents come
once more framed by lines of bad ones (`composed`), so that chains change state. With no
labelled row (or one class only)
all lines count as content.

Null text: as empty (no words, base_failed). Very long texts are read whole. Repeated rows
are judged each for itself. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import exact_ids, labelled_sample, text_id

TRAIN_ROWS = 1000
CONTENT_SHARE = 0.5
MIN_WORDS = 20
WINDOW = 8
RUN, EDGE = 64, 4

_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_FOLLOW = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(0x41, 0x5B))
_DIGITS = b"0123456789"
_LETTERS = bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0x100)])
_MARKS = b"!?=_/\\{}[]^~@+"


def _count(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


def repeat_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of `width` words which the text holds twice or more.

    Windows are compared by a 64-bit hash first; only those whose hash returns are
    compared word by word, so the count is exact.
    """
    n = len(words) - width + 1
    if n < 2 or n == len(set(words)) + 1 - width:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.uint64, len(words))
    w = (w + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    w ^= w >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = h * np.uint64(0xD1B54A32D192ED03) + w[i : i + n]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    at = np.flatnonzero(again).tolist()
    seen = Counter(tuple(words[i : i + width]) for i in at)
    edge = np.zeros(len(words) + 1, np.int64)
    for i in at:
        if seen[tuple(words[i : i + width])] > 1:
            edge[i] += 1
            edge[i + width] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    words = text.split()
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line.strip():
            dup += line in seen
            seen.add(line)
    return len(words), len(text.translate(None, _SPACE + _FOLLOW)), _count(text, _SYMBOLS), dup, repeat_words(words)


N_FEATURES = 14


def line_features(lines: list[bytes]) -> np.ndarray:
    """A row for each line that has a word."""
    seen: set[bytes] = set()
    rows = []
    for line in lines:
        words = line.split()
        n, size = len(words), len(line)
        kinds = len(set(words))
        again = sum(a == b for a, b in zip(words, words[1:])) / n
        upper, letters = _count(line, _UPPER), _count(line, _LETTERS)
        rows.append((
            1.0, min(n, 40) / 40, min(size / n, 20) / 20, kinds / n, again, _count(line, _SYMBOLS) / n,
            upper / (letters + 1), _count(line, _DIGITS) / size, _count(line, _MARKS) / n, line in seen,
            line.rstrip()[-1:] in b".!?:;", _count(line, b".,") / n, n <= 2, letters / size,
        ))
        seen.add(line)
    return np.array(rows, float).reshape(-1, N_FEATURES)


class LineCrf:
    """States: 0 boilerplate, 1 content."""

    def __init__(self, theta: np.ndarray | None = None):
        self.theta = np.zeros(2 * N_FEATURES + 6) if theta is None else theta

    def _parts(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = 2 * N_FEATURES
        return theta[:k].reshape(N_FEATURES, 2), theta[k : k + 4].reshape(2, 2), theta[k + 4 :]

    def fit(self, chains: list[tuple[np.ndarray, np.ndarray]], rounds: int = 80, ridge: float = 1e-3) -> LineCrf:
        """Gradient ascent (Adam) on the likelihood of all chains (features and states of their lines) at once, cut to runs of `RUN` lines and padded."""
        runs = [(x[i : i + RUN], y[i : i + RUN]) for x, y in chains for i in range(0, len(x), RUN)]
        share = Counter(int(y[0]) for _, y in runs)
        if len({int(s) for _, y in runs for s in y}) < 2:
            return self
        weight = np.array([1 / share[int(y[0])] for _, y in runs])
        weight /= weight.sum()
        size = np.array([len(x) for x, _ in runs])
        X, gold = np.zeros((len(runs), size.max(), N_FEATURES)), np.zeros((len(runs), size.max(), 2))
        for i, (x, y) in enumerate(runs):
            X[i, : len(x)] = x
            gold[i, np.arange(len(y)), y] = 1
        live = np.arange(X.shape[1])[None, :] < size[:, None]
        m = v = np.zeros_like(self.theta)
        for step in range(1, rounds + 1):
            g = self._gradient(X, gold, live, weight) - ridge * self.theta
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            self.theta = self.theta + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        return self

    def _gradient(self, X, gold, live, weight) -> np.ndarray:
        W, A, start = self._parts(self.theta)
        E = X @ W
        B, T, _ = E.shape
        alpha, beta = np.zeros((B, T, 2)), np.zeros((B, T, 2))
        alpha[:, 0] = E[:, 0] + start
        for t in range(1, T):
            nxt = np.logaddexp(alpha[:, t - 1, :1] + A[0], alpha[:, t - 1, 1:] + A[1]) + E[:, t]
            alpha[:, t] = np.where(live[:, t, None], nxt, alpha[:, t - 1])
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        pair = np.zeros((2, 2))
        for t in range(T - 2, -1, -1):
            ahead = E[:, t + 1] + beta[:, t + 1]
            back = np.logaddexp(A[:, 0] + ahead[:, :1], A[:, 1] + ahead[:, 1:])
            both = np.exp(alpha[:, t, :, None] + A + ahead[:, None, :] - z[:, None, None])
            pair += ((live[:, t + 1] * weight)[:, None, None] * both).sum(0)
            beta[:, t] = np.where(live[:, t + 1, None], back, 0)
        p = np.exp(alpha + beta - z[:, None, None]) * live[..., None]
        gW = np.einsum("btf,bts,b->fs", X, gold - p, weight)
        gA = np.einsum("bti,btj,b->ij", gold[:, :-1], gold[:, 1:], weight) - pair
        gs = ((gold - p)[:, 0] * weight[:, None]).sum(0)
        return np.concatenate([gW.ravel(), gA.ravel(), gs])

    def decode(self, x: np.ndarray) -> list[int]:
        """The likeliest sequence of states (Viterbi); ties go to content."""
        W, A, start = self._parts(self.theta)
        (a00, a01), (a10, a11) = A.tolist()
        rows = (x @ W).tolist()
        s0, s1 = rows[0][0] + start[0], rows[0][1] + start[1]
        came = []
        for e0, e1 in rows[1:]:
            f0, f1 = s1 + a10 >= s0 + a00, s1 + a11 >= s0 + a01
            s0, s1 = (s1 + a10 if f0 else s0 + a00) + e0, (s1 + a11 if f1 else s0 + a01) + e1
            came.append((int(f0), int(f1)))
        out = [int(s1 >= s0)]
        for step in reversed(came):
            out.append(step[out[-1]])
        return out[::-1]


def composed(rows: list[tuple[np.ndarray, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Chains to learn from: each document with its label on its lines, and each good one once more within lines of a bad one.

    Labels are of documents, so these chains show where content begins and ends.
    """
    chains = [(x, np.full(len(x), y)) for x, y in rows]
    bad = [x for x, y in rows if not y]
    good = [x for x, y in rows if y] if bad else []
    for i, x in enumerate(good):
        before, after = bad[i % len(bad)][: 1 + i % EDGE], bad[(i + 1) % len(bad)][: 1 + i // EDGE % EDGE]
        chains.append((np.concatenate([before, x, after]), np.repeat([0, 1, 0], [len(before), len(x), len(after)])))
    return chains


def train(docs: DataFrame, labels: DataFrame) -> LineCrf:
    rows = [(line_features([x for x in t.split(b"\n") if x.strip()]), y) for t, y in labelled_sample(docs, labels, "quality", TRAIN_ROWS)]
    return LineCrf().fit(composed([(x, y) for x, y in rows if len(x)]))


def content_share(crf: LineCrf, text: bytes) -> tuple[int, int]:
    """(words on content lines, lines of content)"""
    lines = [x for x in text.split(b"\n") if x.strip()]
    if not lines:
        return 0, 0
    states = crf.decode(line_features(lines))
    return sum(len(x.split()) for x, s in zip(lines, states) if s), sum(states)


SCHEMA = "doc_id string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_words long, content_lines long"


def verdict(crf: LineCrf, text: bytes) -> tuple:
    """The columns of SCHEMA after doc_id."""
    n, *counts = base_counts(text)
    failed = n < MIN_WORDS or 100 * counts[3] > 30 * n
    good, lines = content_share(crf, text)
    return n, *counts, failed, not failed and good >= CONTENT_SHARE * n, good, lines


def judge(docs: DataFrame, crf: LineCrf, passing: bool = False) -> DataFrame:
    """A row of counts and verdict for each row of docs (doc_id, text); no shuffle.

    With `passing`, the rows of docs that are kept, all columns as they are.
    """
    if passing:
        own = "_text"
        while own in docs.columns:
            own = "_" + own

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column(own).to_pylist()
                yield b.drop_columns([own]).filter(pa.array([t is not None and verdict(crf, t)[6] for t in texts], pa.bool_()))

        return docs.withColumn(own, F.col("text").cast("binary")).mapInArrow(keep, docs.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b["doc_id"], b["text"]):
                out.append((i, *verdict(crf, bytes(t) if t is not None else b"")))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return exact_ids(docs.select(text_id("doc_id"), F.col("text").cast("binary")).mapInPandas(run, SCHEMA), "doc_id")


def clean_lines(crf: LineCrf, text: str) -> str:
    """The text without the lines that the CRF marks as boilerplate."""
    lines = [x for x in text.encode().split(b"\n") if x.strip()]
    states = crf.decode(line_features(lines)) if lines else []
    return b"\n".join(x for x, s in zip(lines, states) if s).decode()
