"""HTML extraction: a recurrent block labeller.

A page becomes its sequence of leaf blocks (text between block-level tags, references decoded, white space
folded; scripts, styles, comments and form controls hold no text).  Every block is a sum of hashed vectors for the
tags, classes and ids on its path, hashed vectors for its words, and a few counts.  A bidirectional
LSTM in numpy reads the whole sequence and labels each block main text or not.

The labeller is trained on a bounded sample (``SAMPLE_PAGES`` pages): blocks inside ``article`` or ``main``
and outside menus, headers, footers, sidebars, notices, adverts, forms and comments are main text.  Half of the
training sequences are the sample's own paragraphs set into generated layouts (``layout``), with other containers and class
names, so that it doesn't lean on one site's markup.  Training shards are tasks; their weights are averaged
after every round.

Scoring reads every page whole, in batches sorted by length.  A null or empty page, or one without text,
gives the empty string; an unclosed tag at the end is markup; repeated rows each have a row; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample

SAMPLE_PAGES = 240
ROUNDS = 3
SHARDS = 4
STEPS = 60
HIDDEN = 16
PATH_BUCKETS = 2048
WORD_BUCKETS = 1024
#: Blocks a network pass holds at most (padding included).
PASS_BLOCKS = 20_000

BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template textarea select button svg head title iframe object".split())
#: A start tag of these closes an open paragraph, as browsers do it.
CLOSES_P = BLOCK - {"option", "optgroup", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "html", "body", "head"}

#: Start tags that may stand in a head; any other one, or text, ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta title script style noscript noframes template".split())
#: Silent tags that pages forget to close; those without an end tag of their own end at the next block.
FORGOTTEN = frozenset("title button select svg iframe object".split())
#: Of these, a start tag inside another one of its name ends that.
NOT_NESTED = FORGOTTEN - {"svg", "object"}
#: Of these the content is text up to the end tag.
AS_TEXT = frozenset({"title", "iframe"})

_ends = {t: re.compile(rf"<(/?){t}(?=[\s/>])[^>]*>?", re.I) for t in FORGOTTEN}
_markup = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)(?:>|\Z)|!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z))", re.S)
#: Their content is no markup; it ends at their own end tag.
_raw_end = {t: re.compile(rf"</{t}\s*>|\Z", re.I) for t in ("script", "style", "textarea", "noscript", "template")}
_attr = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_part = re.compile(r"[a-z]+")


def _closed(page: str, name: str) -> dict[int, int]:
    """Where the tags ``name`` that have an end tag begin, and where that end tag ends."""
    out: dict[int, int] = {}
    open_: list[int] = []
    for m in _ends[name].finditer(page):
        if not m.group(1):
            if name in NOT_NESTED:
                open_.clear()
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.end()
    return out


def blocks(page: str | None) -> list[tuple[str, tuple[str, ...], int]]:
    """(text, path, characters inside links) of the leaf blocks in page order."""
    out: list = []
    if not page:
        return out
    names: list[str] = []
    paths: list[tuple[str, ...]] = [()]
    parts: list[str] = []
    closed: dict[str, dict[int, int]] = {}
    loose: list[int] = []  # depths of open tags without an end tag of their own
    linked = silent = links = at = 0

    def flush():
        nonlocal linked
        text = "".join(parts)
        if "&" in text:
            text = entities.unescape(text)
        text = " ".join(text.split())
        if text:
            out.append((text, paths[-1], linked))
        parts.clear()
        linked = 0

    def cut(depth):
        nonlocal silent, links
        while len(names) > depth:
            top = names.pop()
            paths.pop()
            silent -= top in SILENT
            links -= top == "a"
        while loose and loose[-1] >= depth:
            loose.pop()

    def close(name):
        cut(len(names) - 1 - names[::-1].index(name))

    while m := _markup.search(page, at):
        if silent and names[-1] == "head" and page[at : m.start()].strip():
            close("head")
        if m.start() > at and not silent:
            raw = page[at : m.start()]
            parts.append(raw)
            linked += len(raw) if links else 0
        at = m.end()
        name = m.group(2)
        if not name:
            continue
        name = name.lower()
        wide = name in BLOCK
        if wide and parts:
            flush()
        if m.group(1):
            # A stray end tag ends nothing; an inline one never ends the block it stands in.
            if name in names and (wide or not any(t in BLOCK for t in names[len(names) - names[::-1].index(name) :])):
                close(name)
            continue
        if silent and name not in IN_HEAD and "head" in names:
            close("head")
        if wide and loose and not (name in ("option", "optgroup") and names[loose[0]] == "select"):
            cut(loose[0])
        if wide and names:
            if name in CLOSES_P and "p" in names:
                inner = next((t for t in reversed(names) if t in BLOCK), None)
                if inner == "p":
                    close("p")
            if name == "li" and names and names[-1] == "li":
                close("li")
        if name == "br":
            parts.append("\n")
        if name in VOID:
            continue
        if name in _raw_end:
            at = _raw_end[name].search(page, at).end()
            continue
        if name in FORGOTTEN:
            if name not in closed:
                closed[name] = _closed(page, name)
            end = closed[name].get(m.start())
            if end and name in AS_TEXT:
                at = end
                continue
            if not end:
                loose.append(len(names))
        attrs = m.group(3)
        own = (name,)
        if "=" in attrs and name != "a":
            own += tuple("." + w for a in _attr.finditer(attrs) for w in _part.findall((a.group(1) or a.group(2) or a.group(3) or "").lower()))
        names.append(name)
        paths.append(paths[-1] + own)
        silent += name in SILENT
        links += name == "a"
    if silent and names[-1] == "head" and page[at:].strip():
        close("head")
    if not silent:
        parts.append(page[at:])
    flush()
    return out


def _bucket(token: str, size: int) -> int:
    return zlib.crc32(token.encode()) % size


class Featurizer:
    """Hashed features of blocks; remembers paths it has seen."""

    def __init__(self):
        self.paths: dict[tuple, list[int]] = {}
        self.words: dict[str, int] = {}

    def word(self, word: str) -> int:
        got = self.words.get(word)
        if got is None:
            if len(self.words) > 200_000:
                self.words.clear()
            got = self.words[word] = _bucket(word, WORD_BUCKETS)
        return got

    def path(self, path: tuple[str, ...]) -> list[int]:
        got = self.paths.get(path)
        if got is None:
            if len(self.paths) > 50_000:
                self.paths.clear()
            tags = [t for t in path if t[0] != "."]
            tokens = {f"^{t}" for t in path} | {f"leaf:{tags[-1] if tags else ''}", f"pair:{'>'.join(tags[-2:])}"}
            got = self.paths[path] = sorted(_bucket(t, PATH_BUCKETS) for t in tokens)
        return got

    def __call__(self, seq: list[tuple[str, tuple[str, ...], int]]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        paths = [self.path(p) for _, p, _ in seq]
        words = [[self.word(w) for w in t.lower().split()] for t, _, _ in seq]
        plain = np.array([[min(1.0, k / max(1, len(t))), min(8.0, np.log1p(len(t))) / 8, t.count(" ") / max(1, len(t)) * 5, float(t[-1:] in ".!?")] for t, _, k in seq], np.float32).reshape(-1, 4)
        return paths, words, plain


# The network: x = sum of path vectors + mean of word vectors + counts; LSTM both ways; a logistic output.


def start_weights(seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    f = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    d = HIDDEN
    w = {"path": f(PATH_BUCKETS, d) * 8, "word": np.zeros((WORD_BUCKETS, d), np.float32), "plain": f(4, d)}
    for k in "fb":
        w |= {f"x{k}": f(d, 4 * d), f"h{k}": f(d, 4 * d), f"c{k}": np.concatenate([np.zeros(d), np.ones(d), np.zeros(2 * d)]).astype(np.float32)}
    return w | {"out": f(3 * d), "bias": np.zeros(1, np.float32)}


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _inputs(w, feats):
    """(blocks, d) inputs of many sequences in a row, and the flat indices behind them."""
    paths = [p for f in feats for p in f[0]]
    words = [p for f in feats for p in f[1]]
    plain = np.concatenate([f[2] for f in feats])

    def flat(lists):
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((v for x in lists for v in x), np.int64, int(n.sum())), np.repeat(np.arange(len(lists)), n), n

    def summed(vectors, n):
        out = np.zeros((len(n), vectors.shape[1]), np.float32)
        some = n > 0
        if some.any():
            out[some] = np.add.reduceat(vectors, (np.cumsum(n) - n)[some])
        return out

    pi, pr, pn = flat(paths)
    wi, wr, wn = flat(words)
    scale = (1 / np.maximum(1, wn)).astype(np.float32)
    x = plain @ w["plain"] + summed(w["path"][pi], pn) + summed(w["word"][wi], wn) * scale[:, None]
    return x, (pi, pr, wi, wr, scale, plain)


def _lstm(x, mask, wx, wh, c0, keep):
    """x: (steps, sequences, d).  States of every step, and what the backward pass needs."""
    steps, n, d = x.shape
    h, c = np.zeros((n, d), np.float32), np.zeros((n, d), np.float32)
    xs = x.reshape(-1, d) @ wx
    xs = xs.reshape(steps, n, 4 * d) + c0
    out, cache = np.empty_like(x), []
    for t in range(steps):
        a = xs[t] + h @ wh
        g = _sigmoid(a[:, : 3 * d])
        i, f, o = g[:, :d], g[:, d : 2 * d], g[:, 2 * d :]
        u = np.tanh(a[:, 3 * d :])
        c1 = f * c + i * u
        tc = np.tanh(c1)
        m = mask[t][:, None]
        if keep:
            cache.append((i, f, o, u, c, tc, h, m))
        c = c1 * m + c * (1 - m)
        h = o * tc * m + h * (1 - m)
        out[t] = h
    return out, cache


def _lstm_back(dout, x, cache, wx, wh):
    steps, n, d = x.shape
    dwx, dwh, dc0 = np.zeros_like(wx), np.zeros_like(wh), np.zeros(4 * d, np.float32)
    dx, dh, dc = np.empty_like(x), np.zeros((n, d), np.float32), np.zeros((n, d), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, u, c, tc, h, m = cache[t]
        dh = dh + dout[t]
        go, keep_h, keep_c = dh * m, dh * (1 - m), dc * (1 - m)
        dcn = dc * m + go * o * (1 - tc * tc)
        da = np.concatenate([dcn * u * i * (1 - i), dcn * c * f * (1 - f), go * tc * o * (1 - o), dcn * i * (1 - u * u)], 1)
        dwx += x[t].T @ da
        dwh += h.T @ da
        dc0 += da.sum(0)
        dx[t] = da @ wx.T
        dh = keep_h + da @ wh.T
        dc = keep_c + dcn * f
    return dx, dwx, dwh, dc0


def _pad(x, lengths):
    steps, n = max(lengths), len(lengths)
    place = np.zeros((n, steps), bool)
    for k, m in enumerate(lengths):
        place[k, :m] = True
    wide = np.zeros((n, steps, x.shape[1]), np.float32)
    wide[place] = x
    back = np.array([[m - 1 - t if t < m else t for t in range(steps)] for m in lengths])
    return wide.transpose(1, 0, 2), place.T.astype(np.float32), place, back


def forward(w, feats, keep=False):
    """Log-odds that a block is main text, for all blocks of the sequences in a row."""
    lengths = [len(f[0]) for f in feats]
    x, index = _inputs(w, feats)
    wide, mask, place, back = _pad(x, lengths)
    cols = np.arange(len(lengths))
    turned = wide[back.T, cols]
    hf, cf = _lstm(wide, mask, w["xf"], w["hf"], w["cf"], keep)
    hb, cb = _lstm(turned, mask, w["xb"], w["hb"], w["cb"], keep)
    both = np.concatenate([hf, hb[back.T, cols], wide], 2)
    logit = both @ w["out"] + w["bias"]
    return logit.T[place], (x, index, wide, turned, place, back, cols, cf, cb, both)


def gradients(w, feats, y):
    logit, (x, index, wide, turned, place, back, cols, cf, cb, both) = forward(w, feats, True)
    d = HIDDEN
    e = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
    wide_e = np.zeros(place.shape, np.float32)
    wide_e[place] = e
    wide_e = wide_e.T
    g = {"out": np.einsum("tnd,tn->d", both, wide_e), "bias": np.array([e.sum()], np.float32)}
    dboth = wide_e[:, :, None] * w["out"]
    dx1, g["xf"], g["hf"], g["cf"] = _lstm_back(dboth[:, :, :d], wide, cf, w["xf"], w["hf"])
    dback = dboth[:, :, d : 2 * d][back.T, cols]
    dx2, g["xb"], g["hb"], g["cb"] = _lstm_back(dback, turned, cb, w["xb"], w["hb"])
    dwide = dx1 + dx2[back.T, cols] + dboth[:, :, 2 * d :]
    dx = dwide.transpose(1, 0, 2)[place]
    pi, pr, wi, wr, scale, plain = index
    g["plain"] = plain.T @ dx
    g["path"], g["word"] = np.zeros_like(w["path"]), np.zeros_like(w["word"])
    np.add.at(g["path"], pi, dx[pr])
    np.add.at(g["word"], wi, dx[wr] * scale[wr][:, None])
    return g


def train_shard(w, data, seed, steps=STEPS, batch=16, rate=0.01):
    """Adam over one shard's sequences; returns the new weights."""
    rng = np.random.default_rng(seed)
    w = {k: v.copy() for k, v in w.items()}
    m, s = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    for t in range(1, steps + 1):
        pick = rng.integers(0, len(data), batch)
        g = gradients(w, [data[k][0] for k in pick], np.concatenate([data[k][1] for k in pick]))
        for k in w:
            g[k] = g[k] + 1e-4 * w[k] * (k in ("word", "path"))
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            s[k] = 0.99 * s[k] + 0.01 * g[k] * g[k]
            w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-7)
    return w


_AWAY = frozenset("nav header footer aside form menu dialog search .nav .menu .header .footer .sidebar .side .aside .ad .ads .advert .advertisement .promo .sponsor .sponsored .banner .notice .cookie .consent .newsletter .subscribe .comment .comments .reply .share .social .related .breadcrumb .login .modal .popup .widget .navigation .complementary .contentinfo .search".split())
_HOME = frozenset("article main .article .content .post .entry .story".split())


def teacher(path: tuple[str, ...]) -> int:
    """The label a block's path gives in those training pages that have a container of a known kind."""
    home = [k for k, t in enumerate(path) if t in _HOME]
    return int(bool(home) and not any(t in _AWAY for t in path))


#: Marks main blocks of generated pages; it tells their label and is taken out before anything is learned.
PLANTED = "plantedmainblock"


def unmarked(seq: list) -> list:
    """Blocks without the mark."""
    return [(t, tuple(x for x in p if x != f".{PLANTED}"), k) for t, p, k in seq]


def layout(paragraphs: list[str], rest: list[str], rng) -> tuple[str, list[str]]:
    """A generated page: an article of the paragraphs, with other things around and inside it.

    The article's blocks carry a mark, whatever they stand in: a container of a known kind, or none at all (the
    body itself, divs without a telling name, table cells), where only the page as a whole tells them apart."""
    one = lambda options: options[int(rng.integers(len(options)))]
    esc = lambda t: entities.escape(t, quote=False)
    some = lambda: esc(one(rest)[: int(rng.integers(20, 400))]) or "x"
    chance = lambda p: rng.random() < p
    links = lambda n: "".join(f'<li><a href="/{k}">{esc(one(rest).split(" ")[0] or "x")}</a></li>' for k in range(n))
    nav = lambda: one([f"<nav><ul>{links(int(rng.integers(3, 9)))}</ul></nav>", f'<div class="{one(["menu", "nav", "navigation", "navbar nav"])}"><ul>{links(5)}</ul></div>', f'<ul class="menu">{links(4)}</ul>', f'<div role="navigation"><ul>{links(4)}</ul></div>'])
    ad = lambda: f'<div class="{one(["ad", "ads", "advert", "advertisement", "ad banner", "promo", "sponsored", "ad-slot"])}">{some()}</div>'
    side = lambda: one([f"<aside><p>{some()}</p><ul>{links(3)}</ul></aside>", f'<div class="{one(["sidebar", "side", "related", "widget", "share social"])}"><h3>{some()}</h3><p>{some()}</p></div>'])
    notice = lambda: f'<div class="{one(["cookie notice", "notice", "cookie-banner", "consent", "newsletter", "popup modal", "banner"])}"><p>{some()}</p></div>'
    form = lambda: f'<form action="/s"><label>{some()}</label><input name="q"><p>{some()}</p></form>'
    comments = lambda: one(["<section class=\"comments\"><h2>%s</h2>%s</section>", "<div id=\"comments\"><h3>%s</h3>%s</div>", "<div class=\"comment-list\"><h3>%s</h3>%s</div>", "<ol class=\"comments\"><li>%s</li>%s</ol>"]) % (some(), "".join(f'<div class="comment"><p>{some()}</p></div>' for _ in range(int(rng.integers(1, 4)))))
    head = lambda: one([f"<header><h1>{some()}</h1><p>{some()}</p></header>", f'<div class="header"><p>{some()}</p></div>', f"<header><p>{some()}</p>{nav()}</header>"])
    foot = lambda: one([f"<footer>&copy; {some()}</footer>", f'<div class="footer"><p>{some()}</p></div>', f"<footer><p>{some()}</p><ul>{links(3)}</ul></footer>", f'<div id="footer">{some()}</div>'])
    body = []
    for k, p in enumerate(paragraphs):
        tag = "h1" if k == 0 and chance(0.7) else one(["p"] * 9 + ["h2", "blockquote", "li", "div"])
        text = esc(p)
        if chance(0.15):
            text = f'<a href="/x">{text}</a>' if chance(0.3) else f"<b>{text}</b>"
        mark = f' class="{PLANTED}"'
        body.append(f"<ul><li{mark}>{text}</li></ul>" if tag == "li" else f"<{tag}{mark}>{text}</{tag}>")
        if chance(0.12):
            body.append(one([ad, side, form, notice])())
    open_, close = one([("<article>", "</article>")] * 4 + [("<main>", "</main>"), ('<main><article class="post">', "</article></main>"), ('<div class="content">', "</div>"), ('<div class="post entry">', "</div>"), ('<div id="content"><div class="article body">', "</div></div>"), ('<section class="story">', "</section>")])
    if chance(0.4):  # no container that says what it holds
        open_, close = one([("", ""), ("<div>", "</div>"), ("<div><div>", "</div></div>"), (f'<div id="{one(["txt", "c1", "b2", "page", "x", "wrap", "col"])}">', "</div>"), (f'<div class="{one(["row", "inner", "w80", "block", "c", "box"])}">', "</div>"), ("<table><tr><td>", "</td></tr></table>"), ("<center>", "</center>")])
        plain = one([f"<ul>{links(int(rng.integers(3, 9)))}</ul>", "<div>" + " | ".join(f'<a href="/{k}">{esc(one(rest).split(" ")[0] or "x")}</a>' for k in range(int(rng.integers(3, 8)))) + "</div>", "<table><tr><td>" + "</td><td>".join(f'<a href="/{k}">{esc(one(rest).split(" ")[0] or "x")}</a>' for k in range(4)) + "</td></tr></table>"])
        last = one([f"<div>&copy; {int(rng.integers(1998, 2026))} {esc(' '.join(one(rest).split(' ')[:3]))}</div>", f"<p><a href='/i'>{esc(one(rest).split(' ')[0])}</a> <a href='/p'>{esc(one(rest).split(' ')[0])}</a></p>", f'<div id="{one(["footer", "foot", "bottom"])}"><p>{esc(" ".join(one(rest).split(" ")[:5]))}</p></div>'])
        top = one(["", plain, f'<div id="{one(["nav", "top", "menu"])}"><ul>{links(4)}</ul></div>', nav()])
        parts = [top, ad() if chance(0.2) else "", open_, *body, close, comments() if chance(0.2) else "", last if chance(0.6) else "", foot() if chance(0.2) else ""]
        return "<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join(parts) + "</body></html>", paragraphs
    parts = [nav() if chance(0.8) else "", head() if chance(0.4) else "", notice() if chance(0.3) else "", ad() if chance(0.5) else "", side() if chance(0.25) else "", open_, *body, comments() if chance(0.1) else "", close, comments() if chance(0.35) else "", side() if chance(0.3) else "", form() if chance(0.25) else "", ad() if chance(0.2) else "", foot() if chance(0.8) else ""]
    return "<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join(parts) + "</body></html>", paragraphs


def _sequences(pages: list[str], seed: int, generated: int) -> list:
    rng = np.random.default_rng(seed)
    make = Featurizer()
    read = [blocks(p) for p in pages]
    # A page without a known container has no labels: its article is not to be learned as something else.
    out = [(make(b), np.array([teacher(p) for _, p, _ in b], np.float32)) for b in read if any(teacher(p) for _, p, _ in b)]
    main = [[t for t, p, _ in b if teacher(p)] for b in read]
    main = [m for m in main if m] or [["The first paragraph of a page.", "Another one, a little longer than the first."]]
    rest = [t for b in read for t, p, _ in b] or ["Some words beside the article"]
    for _ in range(generated):
        page, _ = layout(main[int(rng.integers(len(main)))][:40], rest, rng)
        b = blocks(page)
        out.append((make(unmarked(b)), np.array([f".{PLANTED}" in p for _, p, _ in b], np.float32)))
    return out


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, rounds: int = ROUNDS, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Weights from a bounded sample of ``pages`` (page_id, html)."""
    spark = pages.sparkSession
    rows = bounded_sample(pages.where("html is not null").select("page_id", "html"), "page_id", sample_pages)
    sample = [r[0] for r in rows.select("html").sort(F.xxhash64("html"), "html").limit(sample_pages).collect()]
    weights = start_weights()
    names = list(weights)

    for rnd in range(rounds):

        def shard(batches: Iterator[pa.RecordBatch], w=weights, rnd=rnd) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    own = sample[k::SHARDS]
                    new = train_shard(w, _sequences(own, 100 * rnd + k, len(sample) // SHARDS + 40), 1000 * rnd + k, steps, rate=0.01 / (1 + rnd))
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array(["|".join(names)]), pa.array([b"".join(new[n].astype(np.float32).tobytes() for n in names)], pa.binary())], ["id", "names", "body"])

        got = spark.range(0, SHARDS, 1, SHARDS).mapInArrow(shard, "id bigint, names string, body binary").collect()
        bodies = np.mean([np.frombuffer(bytes(r["body"]), np.float32) for r in sorted(got, key=lambda r: r["id"])], 0)
        at, mean = 0, {}
        for n in names:
            size = weights[n].size
            mean[n], at = bodies[at : at + size].reshape(weights[n].shape).astype(np.float32), at + size
        weights = mean
    return weights


def label(pages: list[list], weights: dict[str, np.ndarray]) -> list[np.ndarray]:
    """For each page's blocks whether they are main text."""
    make = Featurizer()
    order = sorted((k for k, b in enumerate(pages) if b), key=lambda k: len(pages[k]))
    out: list = [np.zeros(0, bool)] * len(pages)
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo + 1) * len(pages[order[hi]]) <= PASS_BLOCKS:
            hi += 1
        own = order[lo:hi]
        logit, _ = forward(weights, [make(pages[k]) for k in own])
        for k, v in zip(own, np.split(logit, np.cumsum([len(pages[k]) for k in own])[:-1]), strict=True):
            out[k] = v > 0
        lo = hi
    return out


def extract(pages: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks for every row of ``pages`` (page_id, url, html)."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                read = [blocks(p.as_py()) for p in part.column(2)]
                texts = ["\n".join(t for (t, _, _), k in zip(b, keep, strict=True) if k) for b, keep in zip(read, label(read, weights), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(b) for b in read], pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint, n_blocks bigint")
