"""Packing: Karmarkar-Karp multiway differencing of pieces into windows of one capacity.

Each task tokenises its own documents and packs them by itself, so nothing is shuffled.
A document is cut where a full window ends; what is left is cut into near-equal parts of
at most `PART` tokens. Full pieces are windows of their own. The parts are gathered until
they fill `GROUP` windows; then the differencing method deals them into as few windows as
their total allows, and into one more each time one exceeds the capacity.

Null and empty texts have the closing id alone. Repeated rows are packed each for itself.
Very long texts are cut like others; memory is that of one group of texts or one long text, and one group of parts.
Sequence ids are made of the task's number, which is the same when a task runs again.
Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import exact_ids, text_id

CAPACITY = 2048
PART = 128
GROUP = 512
END_ID = 1
_PARTS = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-&(-/:;=?@\[-`{}~]*)").fullmatch
_CONTROLS = re.compile("[\x1c-\x1f]").search
CACHE = 800_000
TEXTS = 500_000


def differencing(sizes: list[int], k: int) -> np.ndarray:
    """The window (0 to k-1) of each item, by the balanced largest differencing method.

    The items, largest first, form partial partitions of k sums each. The two partitions
    with the largest spread are merged, the largest sum of one with the smallest of the
    other and so on, which leaves the differences, until one partition is left.
    """
    n, rows = len(sizes), -(-len(sizes) // k)
    order = np.argsort(-np.asarray(sizes, np.int64), kind="stable")
    sums, items = np.zeros(rows * k, np.int64), np.full(rows * k, -1, np.int64)
    sums[:n], items[:n] = np.asarray(sizes, np.int64)[order], order
    heap = [(int(x[-1] - x[0]), r, x, i[None]) for r, (x, i) in enumerate(zip(sums.reshape(rows, k), items.reshape(rows, k)))]
    heapq.heapify(heap)
    tick = rows
    while len(heap) > 1:
        (_, _, a, ia), (_, _, b, ib) = heapq.heappop(heap), heapq.heappop(heap)
        s = a + b[::-1]
        down = np.argsort(-s, kind="stable")
        s = s[down]
        heapq.heappush(heap, (int(s[-1] - s[0]), tick, s, np.concatenate([ia, ib[:, ::-1]])[:, down]))
        tick += 1
    window = np.full(n, -1, np.int64)
    for layer in heap[0][3] if heap else ():
        held = layer >= 0
        window[layer[held]] = np.flatnonzero(held)
    return window


def pack(sizes: list[int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """(window of each item, number of windows); no item is larger than the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        window = differencing(sizes, k)
        if not sizes or np.bincount(window, sizes, k).max() <= capacity:
            return window, k
        k += 1


class WordIds:
    """Ids of texts as little-endian bytes, with those of words and of their parts kept until a cache is full.

    Both the normaliser and the splitter of this tokenizer work within white space, so
    the ids of a text are those of its words in turn. A word of Latin letters followed by
    marks is split there by the tokenizer too, and its case is dropped; so new words are
    looked up by their parts, and the letters still unknown are encoded in one call for several texts:
    each ends with a token that ends a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True

    def ask(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, words: set[str]) -> None:
        """Puts the ids of words into the cache."""
        parts, known = self.parts, self.words
        split, marks = [], set()
        for w in words:
            m = _PARTS(w)
            if m:
                x, y = m.groups()
                split.append((w, x.lower(), y))
                marks.add(y)
            else:
                known[w] = self.ask(w).tobytes()
        letters = list({x for _, x, _ in split}.difference(parts))
        if letters:
            ids = self.ask(" ".join(letters))
            raw, at = ids.tobytes(), 0
            for x, end in zip(letters, (4 * np.flatnonzero(self.ends[ids]) + 4).tolist(), strict=True):
                parts[x] = raw[at:end]
                at = end
        for y in marks.difference(parts):
            parts[y] = self.ask(y).tobytes() if y else b""
        known.update([(w, parts[x] + parts[y]) for w, x, y in split])

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > CACHE:
            self.words.clear()
        if len(self.parts) > CACHE:
            self.parts.clear()
        # white space to Python only: such texts are encoded whole
        split = [None if _CONTROLS(t) else t.split() for t in texts]
        new = set().union(*filter(None, split)).difference(self.words)
        self.learn(new)
        ids = self.words.__getitem__
        out = [self.ask(t).tobytes() if s is None else b"".join(map(ids, s)) for t, s in zip(texts, split)]
        for w in new:
            if len(w) >= 64:  # not kept
                del self.words[w]
        return out


_known: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The one of this Python process, so that a worker's next task finds the words of those before."""
    if path not in _known:
        _known[path] = WordIds(path)
    return _known[path]


def together(rows: Iterator[tuple[object, str]]) -> Iterator[list[tuple[object, str]]]:
    """Rows (doc, text) by groups, each closed once it has `TEXTS` characters."""
    group, held = [], 0
    for doc, text in rows:
        group.append((doc, text))
        held += len(text)
        if held >= TEXTS:
            yield group
            group, held = [], 0
    if group:
        yield group


def cuts(n: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    full, rest = divmod(n, CAPACITY)
    out = [(i * CAPACITY, CAPACITY) for i in range(full)]
    parts = -(-rest // PART)
    at = full * CAPACITY
    for p in range(parts):
        size = rest // parts + (p < rest % parts)
        out.append((at, size))
        at += size
    return out


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
SCHEMA = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """A row for each piece; with_ids adds the ids themselves as `ids` (array<int>)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 40, 0
        words = word_ids(tokenizer)
        end = np.array([END_ID], "<u4").tobytes()
        loose: list[tuple] = []
        out: list[tuple] = []
        held = 0

        def piece(doc, start: int, ids: bytes, total: int) -> tuple:
            return (doc, start, len(ids) // 4, zlib.crc32(ids), total, ids if with_ids else None)

        def deal(parts: list[tuple]) -> None:
            nonlocal made
            window, k = pack([p[2] for p in parts])
            offset = [0] * k
            for p, w in zip(parts, window.tolist()):
                out.append((*p[:5], base + made + w, offset[w], p[5]))
                offset[w] += p[2]
            made += k

        def frame() -> pd.DataFrame:
            f = pd.DataFrame(out, columns=[*COLUMNS, "ids"])
            if with_ids:
                f["ids"] = [np.frombuffer(x, "<u4").astype(np.int32) for x in f["ids"]]
            else:
                f = f[COLUMNS]
            out.clear()
            return f

        for b in batches:
            for group in together(zip(b["doc_id"], b["text"].fillna(""))):
                for (doc, _), ids in zip(group, words.encode([t for _, t in group])):
                    ids += end
                    total = len(ids) // 4
                    for start, size in cuts(total):
                        p = piece(doc, start, ids[4 * start : 4 * (start + size)], total)
                        if size == CAPACITY:
                            out.append((*p[:5], base + made, 0, p[5]))
                            made += 1
                        else:
                            loose.append(p)
                            held += size
                        if held >= GROUP * CAPACITY:
                            deal(loose)
                            loose.clear()
                            held = 0
                        if len(out) >= 20_000:
                            yield frame()
            if out:
                yield frame()
        if loose:
            deal(loose)
            yield frame()

    return exact_ids(docs.select(text_id("doc_id"), "text").mapInPandas(run, SCHEMA + ", ids array<int>" * with_ids), "doc_id")
