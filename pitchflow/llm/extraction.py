"""HTML extraction: a bidirectional LSTM labels each leaf block of a page as main text or not.

A page is cut into leaf blocks at the tags of block elements. A block's input is a vector
of its tag path (hashed tags, classes, ids and roles of the open elements), of its words
(hashed, with weights by length) and a few shape numbers. The LSTM (numpy, both
directions) reads all blocks of a page in order, so each is judged by what stands around
it. It is trained on the driver on `TRAIN_PAGES` pages that `training_page` composes from
a fixed seed: a third hold the article in an element that says so, others in plain ones,
with menus, adverts, forms, notices, sidebars and reader comments around and within.

Null and empty html give an empty text. Very long pages are read whole. Broken markup is
read as it comes. Repeated rows are read each for itself. Columns other than page_id, url
and html are passed over.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import exact_ids, text_id

TRAIN_PAGES = 700
PATH_DIM, WORD_DIM, SHAPE_DIM, HIDDEN = 384, 32, 8, 20
SEED = 4

# possessive: each attempt reads a character once; quotes count after an equals sign alone
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+)>""")
_NAMED = re.compile(r"</?[a-zA-Z]")
_OTHER = re.compile(r"<[!?/][^>]*+>")
# all up to the end tag goes; without one, only of the first four the rest of the page does
_RAW = frozenset("script style title textarea noscript template svg iframe object canvas math audio video".split())
_TO_END = frozenset("script style title textarea".split())
_IN_HEAD = frozenset("base link meta noscript script style template title".split())
_ATTR = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PIECE = re.compile(r"[a-z]+")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = frozenset("address article aside blockquote body details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(tag path, text, characters within links) of each leaf block that has a text."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, str]] = []
    run: list[str] = []
    links = in_link = 0

    def close() -> None:
        nonlocal links
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                out.append((tuple(x for _, x in stack), text, links))
            run.clear()
        links = 0

    at, size, no_end, opened = 0, len(page), set(), Counter()

    def leave(name: str) -> None:
        while True:
            last = stack.pop()[0]
            opened[last] -= 1
            if last == name:
                return

    while at < size:
        lt = page.find("<", at)
        m = skip = None
        while lt >= 0:
            if page.startswith("<!--", lt):
                shut = page.find("-->", lt + 4)
                skip = size if shut < 0 else shut + 3
                break
            if m := _TAG.match(page, lt):
                break
            if page.find(">", lt) < 0 or (_NAMED.match(page, lt)):
                lt = -1  # no tag ends from here on
            elif other := _OTHER.match(page, lt):
                skip = other.end()
                break
            else:
                lt = page.find("<", lt + 1)
        end = lt if lt >= 0 else size
        if end > at:
            piece = page[at:end]
            run.append(piece)
            if in_link:
                links += len(piece.strip())
        if lt < 0:
            break
        if m is None:
            at = skip
            continue
        at = m.end()
        name = m[2].lower()
        if name in _RAW and not m[1] and not m[3].endswith("/"):
            found = None if name in no_end else re.compile(rf"</{name}\s*+>", re.IGNORECASE).search(page, at)
            if found:
                at = found.end()
                run.append(" ")
                continue
            no_end.add(name)
            if name in _TO_END:
                at = size
            continue
        if name == "a":
            in_link = not m[1]
        if name in _INLINE:
            continue
        if name == "br":
            run.append(" ")
            continue
        close()
        if m[1]:
            if opened[name]:
                leave(name)
            in_link = 0
        else:
            if opened["head"] and name not in _IN_HEAD and name != "head":
                leave("head")
            if name in _ENDS_P and stack and stack[-1][0] == "p":
                leave("p")
            if name == "li" and stack and stack[-1][0] == "li":
                leave("li")
            if name not in _VOID and not m[3].endswith("/"):
                words = _PIECE.findall(" ".join(filter(None, (x for g in _ATTR.findall(m[3]) for x in g))).lower()) if m[3] else ()
                opened[name] += 1
                stack.append((name, " ".join([name, *("." + w for w in words)])))
    close()
    return [b for b in out if not (b[0] and any(x.split(" ", 1)[0] == "head" for x in b[0]))]


@cache
def _slot(word: str, dim: int) -> int:
    return zlib.crc32(word.encode()) % dim


def path_slots(path: tuple[str, ...]) -> list[int]:
    """The slots of the path's tags and names; the last element is there once more by itself."""
    names = {x for e in path for x in e.split(" ")}
    if path:
        names |= {"last:" + x for x in path[-1].split(" ")}
    return sorted({_slot(x, PATH_DIM) for x in names})


class _Slots(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = x = zlib.crc32(word.encode()) % WORD_DIM
        return x


_word_slots = _Slots()


def word_vector(text: str, links: int, at: int, of: int) -> np.ndarray:
    words = text.lower().split(" ")
    n = len(words)
    v = np.zeros(WORD_DIM + SHAPE_DIM, np.float32)
    v[:WORD_DIM] = np.sqrt(np.bincount(np.fromiter(map(_word_slots.__getitem__, words), np.int64, n), minlength=WORD_DIM) / n)
    v[WORD_DIM:] = (
        np.log1p(n) / 5, min(1.0, links / max(1, len(text))), (text.count(".") + text.count(",")) / n, text[-1] in ".!?",
        at / of, 1 / of, np.log1p(len(text)) / 8, n < 4,
    )
    return v


class Labeller:
    """Weights: for each direction input, path, recurrent and bias; then the output."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        g = 4 * HIDDEN
        mk = lambda a, b, s: (r.standard_normal((a, b)) * s).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {"P" + d: mk(PATH_DIM, g, 0.15), "X" + d: mk(WORD_DIM + SHAPE_DIM, g, 0.15), "R" + d: mk(HIDDEN, g, 0.2), "B" + d: np.zeros(g, np.float32)}
            self.p["B" + d][HIDDEN : 2 * HIDDEN] = 1
        self.p |= {"O": mk(2 * HIDDEN, 1, 0.3), "b": np.zeros(1, np.float32)}
        self._paths: dict[tuple[str, ...], np.ndarray] = {}

    @staticmethod
    def _run(z: np.ndarray, R: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, list]:
        """z: (T, B, 4H) inputs of the gates. Padding comes last in each row."""
        T, B, _ = z.shape
        h = c = np.zeros((B, HIDDEN), np.float32)
        out, memo = np.zeros((T, B, HIDDEN), np.float32), []
        for t in range(T):
            a = z[t] + h @ R
            s = 1 / (1 + np.exp(-np.clip(a[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(a[:, 3 * HIDDEN :])
            c2 = np.where(live[t], f * c + i * g, c)
            tc = np.tanh(c2)
            h2 = np.where(live[t], o * tc, h)
            memo.append((i, f, o, g, c, tc, h))
            h, c = h2, c2
            out[t] = h
        return out, memo

    def _flip(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Each row's live part backwards; padding stays last."""
        T, B = x.shape[:2]
        at = np.where(np.arange(T)[:, None] < size, size - 1 - np.arange(T)[:, None], np.arange(T)[:, None])
        return x[at, np.arange(B)]

    def path_input(self, path: tuple[str, ...]) -> np.ndarray:
        v = self._paths.get(path)
        if v is None:
            if len(self._paths) > 20_000:
                self._paths.clear()
            s = path_slots(path)
            v = self._paths[path] = np.concatenate([self.p["Pf"][s].sum(0) + self.p["Bf"], self.p["Pb"][s].sum(0) + self.p["Bb"]])
        return v

    def label(self, pages: list[list[tuple[tuple[str, ...], str, int]]], cells: int = 40_000) -> list[np.ndarray]:
        """For each page, whether each block is main text. Pages of like length run together."""
        out: list = [np.zeros(0, bool)] * len(pages)
        todo = sorted((i for i, b in enumerate(pages) if b), key=lambda i: len(pages[i]))
        at = 0
        while at < len(todo):
            end = at + 1
            while end < len(todo) and end - at < 512 and len(pages[todo[end]]) * (end - at + 1) <= cells:
                end += 1
            group = todo[at:end]
            at = end
            size = np.array([len(pages[i]) for i in group])
            T, B, g = int(size.max()), len(group), 4 * HIDDEN
            X = np.zeros((T, B, WORD_DIM + SHAPE_DIM), np.float32)
            P = np.zeros((T, B, 2 * g), np.float32)
            for j, i in enumerate(group):
                for t, (path, text, links) in enumerate(pages[i]):
                    X[t, j] = word_vector(text, links, t, size[j])
                    P[t, j] = self.path_input(path)
            live = (np.arange(T)[:, None] < size)[..., None]
            score = self.p["b"]
            for k, d in enumerate("fb"):
                z = X @ self.p["X" + d] + P[..., k * g : (k + 1) * g]
                z = self._flip(z, size) if k else z
                h, _ = self._run(z, self.p["R" + d], live)
                h = self._flip(h, size) if k else h
                score = score + (h @ self.p["O"][k * HIDDEN : (k + 1) * HIDDEN])[..., 0]
            for j, i in enumerate(group):
                out[i] = score[: size[j], j] > 0
        return out

    def fit(self, pages: list[tuple[list, list[bool]]], epochs: int = 14, batch: int = 32, rate: float = 0.012) -> Labeller:
        """Adam on the log loss of every block, by back-propagation through time."""
        r = np.random.default_rng(SEED)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        data = [(np.stack([word_vector(x, k, t, len(b)) for t, (_, x, k) in enumerate(b)]), [path_slots(p) for p, _, _ in b], np.array(y, np.float32)) for b, y in pages if b]
        step, steps = 0, epochs * -(-len(data) // batch)
        for _ in range(epochs):
            # pages of like length share a batch
            order = np.lexsort((r.random(len(data)), [len(y) // 8 for _, _, y in data]))
            for lo in r.permutation(np.arange(0, len(data), batch)):
                rows = [data[i] for i in order[lo : lo + batch]]
                g = self._gradients(rows, r)
                step += 1
                pace = rate * (1 - step / (steps + 1))
                for k, x in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v2[k] = 0.999 * v2[k] + 0.001 * x * x
                    self.p[k] = (self.p[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
        self._paths.clear()
        return self

    def _gradients(self, rows: list, r: np.random.Generator) -> dict[str, np.ndarray]:
        size = np.array([len(y) for _, _, y in rows])
        T, B = int(size.max()), len(rows)
        X, S, Y = np.zeros((T, B, WORD_DIM + SHAPE_DIM), np.float32), np.zeros((T, B, PATH_DIM), np.float32), np.zeros((T, B), np.float32)
        for j, (x, slots, y) in enumerate(rows):
            X[: len(y), j], Y[: len(y), j] = x, y
            for t, s in enumerate(slots):
                S[t, j, s] = 1
        live = (np.arange(T)[:, None] < size)[..., None]
        S *= r.random(S.shape) > 0.1  # some names are hidden, so that others are learnt too
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        runs, score = {}, self.p["b"] + np.zeros((T, B), np.float32)
        for k, d in enumerate("fb"):
            x, s = (self._flip(X, size), self._flip(S, size)) if k else (X, S)
            h, memo = self._run(x @ self.p["X" + d] + s @ self.p["P" + d] + self.p["B" + d], self.p["R" + d], live)
            runs[d] = (x, s, memo, self._flip(h, size) if k else h)
            score += (runs[d][3] @ self.p["O"][k * HIDDEN : (k + 1) * HIDDEN])[..., 0]
        e = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - Y) * live[..., 0] / live.sum()
        grads["b"][0] = e.sum()
        for k, d in enumerate("fb"):
            x, s, memo, h = runs[d]
            O = self.p["O"][k * HIDDEN : (k + 1) * HIDDEN]
            grads["O"][k * HIDDEN : (k + 1) * HIDDEN] = np.einsum("tbh,tb->h", h, e)[:, None]
            dh_all = e[..., None] * O[:, 0]
            dh_all = self._flip(dh_all, size) if k else dh_all
            R, dh, dc = self.p["R" + d], np.zeros((B, HIDDEN), np.float32), np.zeros((B, HIDDEN), np.float32)
            da_all = np.zeros((T, B, 4 * HIDDEN), np.float32)
            for t in range(T - 1, -1, -1):
                i, f, o, g, c, tc, h0 = memo[t]
                on = live[t]
                dh = dh + dh_all[t]
                dcc = np.where(on, dc + dh * o * (1 - tc * tc), 0)
                da = np.concatenate([dcc * g * i * (1 - i), dcc * c * f * (1 - f), np.where(on, dh * tc, 0) * o * (1 - o), dcc * i * (1 - g * g)], 1)
                da_all[t] = da
                grads["R" + d] += h0.T @ da
                dh = np.where(on, da @ R.T, dh)
                dc = np.where(on, dcc * f, dc)
            flat = da_all.reshape(T * B, -1)
            grads["X" + d], grads["P" + d], grads["B" + d] = x.reshape(T * B, -1).T @ flat, s.reshape(T * B, -1).T @ flat, flat.sum(0)
        return grads


def training_page(r: random.Random) -> str:
    """A page whose main blocks start with the mark U+E000."""
    sounds = "ba ce di fo gu ha ki lo mu ne pa ri so tu va we xi yo zu ar en il on th sh ing er".split()
    word = lambda: "".join(r.choice(sounds) for _ in range(r.randint(1, 4)))

    def prose(lo: int, hi: int) -> str:
        ws = [word() for _ in range(r.randint(lo, hi))]
        for i in range(len(ws)):
            if r.random() < 0.12:
                ws[i] += r.choice(",.,.;!")
            if r.random() < 0.03:
                ws[i] = f"<{(t := r.choice(['b', 'i', 'em', 'strong', 'span']))}>{ws[i]}</{t}>"
            if r.random() < 0.01:
                ws[i] = f'<a href="/{word()}">{ws[i]}</a>'
            if r.random() < 0.02:
                ws[i] += r.choice(["&amp;", "&#233;", "&copy;", "***", "$$$", "%%%"])
        return " ".join(ws).capitalize() + r.choice([".", ".", ".", ""])

    def named(tag: str, *names: str) -> str:
        n = r.choice(names)
        n = n + r.choice(["", "", f" {word()}", f"-{word()}", f"-{r.randint(1, 9)}"])
        return f'<{tag} {r.choice(["class", "class", "id"])}="{n}">'

    links = lambda n: "".join(f'<li><a href="/{word()}">{r.choice([word(), word(), "Home", "About", "Contact", prose(1, 5)])}</a></li>' for _ in range(n))
    main = lambda s: "" + s

    def menu() -> str:
        ul = f"<ul>{links(r.randint(2, 9))}</ul>"
        return r.choice([f"<nav>{ul}</nav>", f"<nav>{ul}</nav>", named("div", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar", "toolbar") + ul + "</div>", named("ul", "menu", "nav", "tabs", "pagination") + links(4) + "</ul>"])

    def advert() -> str:
        return named(r.choice(["div", "div", "section", "aside", "p"]), "ad", "ads", "advert", "advertisement", "banner", "sponsored", "sponsor", "promo", "promotion") + r.choice([prose(3, 40), f"<p>{prose(3, 40)}</p>", f"<h3>{prose(2, 5)}</h3><p>{prose(5, 30)}</p>"])

    def shut(x: str) -> str:
        return x + f"</{re.match(r'<(\w+)', x)[1]}>"

    def notice() -> str:
        return shut(named(r.choice(["div", "div", "section"]), "cookie", "cookies", "consent", "notice", "gdpr", "popup", "modal", "alert", "newsletter", "subscribe", "overlay", "cookie-banner") + r.choice([prose(5, 40), f"<p>{prose(5, 40)}</p><button>{word()}</button>"]))

    def form() -> str:
        inner = f"<label>{prose(1, 4)}</label><input name=x>" * r.randint(1, 3) + r.choice(["", f"<p>{prose(4, 25)}</p>", f"<select><option>{word()}</option><option>{word()}</option></select>"]) + f"<button>{prose(1, 3)}</button>"
        return r.choice([f"<form>{inner}</form>", named("form", "search", "login", "signup", "contact", "form") + inner + "</form>"])

    def side() -> str:
        body = "".join(r.choice([f"<h3>{prose(1, 5)}</h3>", f"<ul>{links(r.randint(2, 6))}</ul>", f"<p>{prose(5, 60)}</p>"]) for _ in range(r.randint(1, 4)))
        return r.choice([f"<aside>{body}</aside>", named("div", "sidebar", "side", "aside", "widget", "related", "popular", "recommended", "rail", "trending", "more", "share", "social", "tags", "author-bio", "toc") + body + "</div>"])

    def comments() -> str:
        one = lambda: r.choice([f"<p>{prose(5, 80)}</p>", f"<b>{word()}</b><p>{prose(5, 80)}</p><p>{prose(5, 50)}</p>"])
        many = "".join(r.choice([named("div", "comment", "reply", "comment-body") + one() + "</div>", f"<li>{one()}</li>", f"<article>{one()}</article>"]) for _ in range(r.randint(1, 6)))
        head = r.choice(["", f"<h2>{prose(1, 3)}</h2>", f"<h3>Comments</h3>"])
        return shut(named(r.choice(["div", "section", "ol", "ul"]), "comments", "comment", "comment-list", "responses", "discussion", "replies", "disqus", "reviews") + head + many)

    def part() -> str:
        p = lambda: f"<p>{main(prose(2, 120))}" + r.choice(["</p>", "</p>", "</p>", ""])
        kind = r.random()
        if kind < 0.75:
            return r.choice([p(), p(), p(), f"<p><b>{main(prose(3, 60))}<br><p>{main(prose(3, 80))}</p>", f"<div>{main(prose(5, 60))}</div>"])
        if kind < 0.85:
            return f"<{(h := r.choice(['h2', 'h3', 'h4']))}>{main(prose(1, 8))}</{h}>"
        if kind < 0.91:
            return "<ul>" + "".join(f"<li>{main(prose(2, 25))}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.94:
            return f"<blockquote>{r.choice([main(prose(4, 50)), '<p>' + main(prose(4, 50)) + '</p>'])}</blockquote>"
        if kind < 0.96:
            return f"<pre>{main(prose(3, 30))}</pre>"
        if kind < 0.98:
            return f"<figure><img src=x><figcaption>{main(prose(2, 15))}</figcaption></figure>"
        return "<table>" + "".join(f"<tr><td>{main(prose(1, 4))}</td><td>{main(prose(1, 4))}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>"

    body = r.choice(["", f"<h1>{main(prose(2, 12))}</h1>", f"<h1>{main(prose(2, 12))}</h1>", f"<header><h1>{main(prose(2, 12))}</h1></header>"])
    if r.random() < 0.15:
        again = f"<p>{main(prose(1, 6))}</p>"
        body += part() + again * r.choice([5, 20, 40, 90]) + part()
    for _ in range(r.choice([1, 1, 2, 3, 5, 8, 13, 21])):
        body += part()
        if r.random() < 0.06:
            body += r.choice([lambda: shut(advert()), side, notice, form])()
    kind = r.random()
    if kind < 0.4:
        body = f"<article>{body}</article>"
    elif kind < 0.5:
        body = f"<main>{body}</main>"
    elif kind < 0.56:
        body = f"<main><article>{body}</article></main>"
    elif kind < 0.9:
        body = shut(named(r.choice(["div", "div", "section"]), "content", "post", "entry", "entry-content", "article", "article-body", "story", "main", "main-content", "post-body", "text", "body", "page", word(), word()) + body)
    wrap = r.choice(["", "", "wrapper", "container", "page", "site", word()])
    before = [r.choice([menu, menu, lambda: shut(advert()), notice, form, side, lambda: f"<header>{r.choice(['', f'<h1>{prose(1, 4)}</h1>', f'<p>{prose(2, 12)}</p>'])}{r.choice(['', menu()])}</header>", lambda: shut(named("div", "header", "masthead", "top", "site-header") + f"<p>{prose(1, 8)}</p>{r.choice(['', menu()])}")])() for _ in range(r.randint(0, 4))]
    after = [r.choice([side, comments, comments, lambda: shut(advert()), form, notice, menu])() for _ in range(r.choice([0, 1, 1, 2, 3]))]
    foot = r.choice(["", f"<footer>{prose(2, 20)}</footer>", f"<footer><p>&copy; {word()}.example.com &middot; {prose(2, 20)}</p></footer>", f"<footer>{menu()}<p>{prose(2, 20)}</p></footer>", shut(named("div", "footer", "copyright", "legal", "bottom", "colophon") + f"<p>{prose(2, 20)}</p>")])
    inner = "".join(before) + body + "".join(after) + foot
    inner = f'<div class="{wrap}">{inner}</div>' if wrap else inner
    return f"<!DOCTYPE html><html><head><title>{prose(2, 8)}</title><style>p{{margin:0}}</style></head><body>{inner}</body></html>"


def training_data(pages: int, seed: int) -> list[tuple[list, list[bool]]]:
    r = random.Random(seed)
    out = []
    for _ in range(pages):
        found = blocks(training_page(r))
        out.append(([(p, x.replace("", ""), k) for p, x, k in found], ["" in x for _, x, _ in found]))
    return [(b, y) for b, y in out if all(x for _, x, _ in b)]


@cache
def trained() -> Labeller:
    return Labeller().fit(training_data(TRAIN_PAGES, SEED))


def extract(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_main for each row of pages; no shuffle."""
    model = labeller or trained()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for lo in range(0, len(whole), 1000):
                b = whole.iloc[lo : lo + 1000]
                found = [blocks(h or "") for h in b["html"]]
                labels = model.label(found)
                texts = [" ".join(x for (_, x, _), y in zip(f, l) if y) for f, l in zip(found, labels)]
                yield pd.DataFrame({
                    "page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(x) for x in texts],
                    "n_blocks": [len(f) for f in found], "n_main": [int(l.sum()) for l in labels],
                })

    return exact_ids(pages.select(text_id("page_id"), "url", "html").mapInPandas(run, "page_id string, url string, text string, n_chars long, n_blocks long, n_main long"), "page_id")
