"""Main text of web pages by a recurrent labeller of blocks.

A page becomes its leaf blocks in order: runs of text between block-level tags, each with
the path of open tags. A bidirectional LSTM in numpy reads one vector per block (hashed tags,
classes and ids of the path, hashed words, length and link share) and labels each block as
article or not, seeing the whole page. It is trained on made-up pages of many layouts.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohorta.llm.crf import _blocks
from cohorta.llm.udf import on_texts

_RAW = "script style noscript template svg math iframe object textarea select title"  # fixed: elements whose content is no text of the page
RAW_OPEN, RAW_CLOSE = re.compile(rf"<({_RAW.replace(' ', '|')})\b", re.I), {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW.split()}
TAG_NAME = re.compile(r"<(/?)([a-z][a-z0-9:-]*)", re.I)
TAG_EVENT = re.compile(r"[>\"']")
OPEN_END = re.compile(r"</?[a-z!]", re.I)
LONG_REFERENCE, ZEROS = re.compile(r"&#[0-9]{8,}"), re.compile(r"&#0+(?=[0-9])")
#: Elements of a path that count, from the innermost outwards.
PATH_DEPTH = 64
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?until)|display\s*:\s*none""", re.I)
# HTML's elements by what they do to text.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track".split())
CLOSES_SELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SPACE = re.compile(r"\s+")

PATH_BUCKETS, WORD_BUCKETS, NUMBERS, UNITS = 256, 32, 5, 16


class _Page:
    """A page's pieces in order. What lies ahead is looked up once for all places before it,
    so markup that is never closed costs no more than any other."""

    def __init__(self, page: str):
        self.page = page
        self.next_of = {">": (0, -1), "event": (0, -1)}
        self.last_open, self.last_close = page.rfind("<"), page.rfind(">")
        self.lost: set[int] = set()

    def _ahead(self, kind: str, at: int) -> int:
        """Place of the next > (or of the next sign that matters in a tag) from ``at`` on; -1 if there is none."""
        since, found = self.next_of[kind]
        if found == -2 and at >= since:
            return -1
        if not since <= at <= found:
            if kind == ">":
                found = self.page.find(">", at)
            else:
                m = TAG_EVENT.search(self.page, at)
                found = m.start() if m else -1
            self.next_of[kind] = (at, -2 if found < 0 else found)
        return found

    def tag_end(self, at: int) -> int:
        """Place of the > that ends a tag, quoted values passed over; -1 if none does."""
        passed, event = [], self._ahead("event", at)
        while event >= 0 and event not in self.lost:
            if self.page[event] == ">":
                return event
            passed.append(event)
            closing = self.page.find(self.page[event], event + 1)
            later = TAG_EVENT.search(self.page, closing + 1) if closing >= 0 else None
            event = later.start() if later else -1
        self.lost.update(passed)  # from these no tag ends, whichever tag came to them
        return -1

    def __iter__(self):
        """Tuples: text or None, name of a tag or None, whether it closes, its attributes."""
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            if page[at] != "<":
                end = page.find("<", at)
                end = n if end < 0 else end
                yield page[at:end], None, False, ""
                at = end
                continue
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = n if end < 0 else end + 3
                continue
            raw = RAW_OPEN.match(page, at)
            if raw:
                end = self._ahead(">", raw.end())
                if end >= 0 and page[end - 1] != "/":
                    closing = RAW_CLOSE[raw[1].lower()].search(page, end + 1)
                    at = closing.end() if closing else n
                    continue
            tag = TAG_NAME.match(page, at)
            if tag:
                end = self.tag_end(tag.end())
                if end >= 0:
                    yield None, tag[2].lower(), bool(tag[1]), page[tag.end() : end]
                    at = end + 1
                    continue
            if page[at + 1 : at + 2] in ("!", "?", "/"):
                end = self._ahead(">", at + 2)
                if end >= 0:
                    at = end + 1
                    continue
            if at == self.last_open and self.last_close < at and OPEN_END.match(page, at):
                return
            yield "<", None, False, ""
            at += 1


def decoded(text: str) -> str:
    """Character references decoded; numbers beyond all characters may have any number of digits."""
    if "&#" in text:
        text = LONG_REFERENCE.sub("&#99999999", ZEROS.sub("&#", text))
    return entities.unescape(text)


def blocks(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """Leaf blocks of a page in order: path of open block-level tags, text with character
    references decoded and white space joined, and the share of it inside links."""
    out: list[tuple[tuple[str, ...], str, float]] = []
    stack: list[str] = []
    tags: list[str] = []
    is_open: Counter[str] = Counter()
    text: list[str] = []
    linked, in_link = 0, 0

    def flush():
        nonlocal linked, in_link
        if text:
            joined = SPACE.sub(" ", decoded("".join(text))).strip()
            if joined:
                out.append((tuple(stack[-PATH_DEPTH:]), joined, min(1.0, linked / len(joined))))
            text.clear()
        linked = 0

    def leave(upto: int):
        is_open.subtract(tags[upto:])
        del stack[upto:], tags[upto:]

    for piece, name, closing, rest in _Page(page):
        if piece is not None:
            text.append(piece)
            if in_link:
                linked += len(piece)
        if name is None:
            continue
        if name in ("br", "wbr"):
            text.append(" ")
        elif name in INLINE:
            if name == "a":
                in_link = 0 if closing else 1
        elif closing:
            flush()
            if is_open[name] > 0:
                leave(next(i for i in reversed(range(len(tags))) if tags[i] == name))
            in_link = 0
        else:
            flush()
            ends = CLOSES_SELF.get(name, set()) | ({"p"} if name in ENDS_P else set())
            if any(is_open[tag] > 0 for tag in ends):
                for i in reversed(range(len(tags))):
                    if tags[i] in KEEPS.get(name, ()):
                        break
                    if tags[i] in ends:
                        leave(i)
                        break
            if name not in VOID:
                names = " ".join(sorted({w for a in NAMES.findall(rest) for w in re.split(r"[\s_-]+", "".join(a).lower()) if w}))
                stack.append(" ".join(x for x in (name, names, "hidden" if HIDDEN.search(rest) else "") if x))
                tags.append(name)
                is_open[name] += 1
    flush()
    return out


def _bucket(token: str, n: int) -> int:
    return xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass")) % n


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Hashed tags, classes and ids of the path, and once more those of its innermost element."""
    v = np.zeros(PATH_BUCKETS, np.float32)
    for depth, element in enumerate(path):
        tag, *names = element.split(" ")
        for token in (f"tag {tag}", *(f"name {n}" for n in names)):
            v[_bucket(token, PATH_BUCKETS)] = 1
        if depth == len(path) - 1:
            v[_bucket(f"leaf {tag}", PATH_BUCKETS)] = 1
    return v


class TextVectors:
    """Hashed words of blocks, and numbers: length, links, end of sentence."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, own: list[tuple[tuple[str, ...], str, float]]) -> np.ndarray:
        if len(self.known) > 400_000:
            self.known.clear()
        words = [b[1].lower().split() for b in own]
        flat = [w for block in words for w in block]
        for w in set(flat).difference(self.known):
            self.known[w] = _bucket(f"word {w}", WORD_BUCKETS)
        n = np.array([len(w) for w in words], np.int64)
        v = np.zeros((len(own), WORD_BUCKETS + NUMBERS), np.float32)
        at = np.repeat(np.arange(len(own)) * WORD_BUCKETS, n) + np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        counts = np.bincount(at, minlength=len(own) * WORD_BUCKETS).reshape(-1, WORD_BUCKETS)
        v[:, :WORD_BUCKETS] = np.sqrt(counts / np.maximum(n, 1)[:, None])
        v[:, WORD_BUCKETS] = 1
        v[:, WORD_BUCKETS + 1] = np.minimum(2.0, np.log1p(n) / 3)
        v[:, WORD_BUCKETS + 2] = [b[2] for b in own]
        v[:, WORD_BUCKETS + 3] = [b[1][-1:] in ".!?\"”" for b in own]
        v[:, WORD_BUCKETS + 4] = n <= 3
        return v


class Weights:
    """Two directions of an LSTM (gates: in, forget, out, cell) and the output layer."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        init = lambda *s: rng.normal(0, 0.15, s).astype(np.float32)
        gates = 4 * UNITS
        self.p = {}
        for d in "fb":
            self.p |= {f"path_{d}": init(PATH_BUCKETS, gates), f"other_{d}": init(WORD_BUCKETS + NUMBERS, gates), f"again_{d}": init(UNITS, gates), f"bias_{d}": np.zeros(gates, np.float32)}
            self.p[f"bias_{d}"][UNITS : 2 * UNITS] = 1
        self.p |= {"out": init(2 * UNITS), "out_bias": np.zeros(1, np.float32)}


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _run(p: dict, d: str, z: np.ndarray, rows: list[np.ndarray], keep: list | None = None) -> np.ndarray:
    """Hidden values of all blocks; ``rows`` are the block rows of step after step, the
    pages still running standing first (forward), or joining at the end (backward)."""
    out = np.zeros((len(z), UNITS), np.float32)
    h = c = np.zeros((0, UNITS), np.float32)
    for row in rows:
        n = row.size
        if n > len(h):
            more = np.zeros((n - len(h), UNITS), np.float32)
            h, c = np.concatenate((h, more)), np.concatenate((c, more))
        before, c0 = h[:n], c[:n]
        g = z[row] + before @ p[f"again_{d}"]
        i, f, o = (_sigmoid(g[:, k * UNITS : (k + 1) * UNITS]) for k in range(3))
        a = np.tanh(g[:, 3 * UNITS :])
        c = f * c0 + i * a
        t = np.tanh(c)
        h = o * t
        out[row] = h
        if keep is not None:
            keep.append((row, before, c0, i, f, o, a, t))
    return out


def _steps(starts: np.ndarray, running: list[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    ahead = [starts[:k] + t for t, k in enumerate(running)]
    return ahead, ahead[::-1]


def margins(p: dict, inputs: dict[str, np.ndarray], lengths: np.ndarray) -> np.ndarray:
    """Log-odds of each block to be article; inputs: gate inputs per direction."""
    out = np.zeros(int(lengths.sum()), np.float32)
    for starts, _, running in _blocks(lengths):
        ahead, back = _steps(starts, running)
        own = np.concatenate(ahead)
        h = np.zeros((len(out), 0)) if not own.size else np.concatenate((_run(p, "f", inputs["f"], ahead)[own], _run(p, "b", inputs["b"], back)[own]), 1)
        out[own] = h @ p["out"] + p["out_bias"]
    return out


def train_labeller(pages: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rounds: int = 12, batch: int = 30, rate: float = 0.012) -> dict:
    """pages: (path vectors, other vectors, labels). Cross-entropy, back-propagation
    through time, Adam."""
    p = Weights().p
    m, v, t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    rng = np.random.default_rng(9)
    for _ in range(rounds):
        order = rng.permutation(len(pages))
        for at in range(0, len(pages), batch):
            own = [pages[k] for k in order[at : at + batch]]
            lengths = np.array([len(y) for *_, y in own])
            paths, others, y = (np.concatenate([x[k] for x in own]) for k in range(3))
            slopes = {k: np.zeros_like(a) for k, a in p.items()}
            (starts, _, running), = _blocks(lengths)
            kept, hidden = {}, {}
            for d, rows in zip("fb", _steps(starts, running)):
                kept[d] = []
                hidden[d] = _run(p, d, paths @ p[f"path_{d}"] + others @ p[f"other_{d}"] + p[f"bias_{d}"], rows, kept[d])
            both = np.concatenate((hidden["f"], hidden["b"]), 1)
            err = ((_sigmoid(both @ p["out"] + p["out_bias"]) - y) / len(y)).astype(np.float32)
            slopes["out"], slopes["out_bias"] = both.T @ err, np.array([err.sum()], np.float32)
            for k, d in enumerate("fb"):
                to_h = np.outer(err, p["out"][k * UNITS : (k + 1) * UNITS])
                dz = np.zeros((len(y), 4 * UNITS), np.float32)
                dh = dc = np.zeros((0, UNITS), np.float32)
                for row, before, c0, i, f, o, a, th in reversed(kept[d]):
                    n = row.size
                    if n > len(dh):
                        more = np.zeros((n - len(dh), UNITS), np.float32)
                        dh, dc = np.concatenate((dh, more)), np.concatenate((dc, more))
                    g = dh[:n] + to_h[row]
                    c = dc[:n] + g * o * (1 - th * th)
                    gate = np.concatenate((c * a * i * (1 - i), c * c0 * f * (1 - f), g * th * o * (1 - o), c * i * (1 - a * a)), 1)
                    dz[row] = gate
                    slopes[f"again_{d}"] += before.T @ gate
                    dh, dc = gate @ p[f"again_{d}"].T, c * f
                slopes[f"path_{d}"], slopes[f"other_{d}"], slopes[f"bias_{d}"] = paths.T @ dz, others.T @ dz, dz.sum(0)
            t += 1
            for k, slope in slopes.items():
                slope = slope + 1e-4 * p[k] / len(p)
                m[k] += 0.1 * (slope - m[k])
                v[k] += 0.01 * (slope * slope - v[k])
                p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return p


_SYLLABLES = "an be ca de el fi go hu in jo ka li mo ne or pu qua re si to un vi we xa yo zu ß é ñ ó ü ê".split()
VOCABULARY = [a + b for a in _SYLLABLES for b in ["", *_SYLLABLES]] + [a + b + c for a in _SYLLABLES[::3] for b in _SYLLABLES[::2] for c in _SYLLABLES[::2]]


def made_up_page(rng: np.random.Generator) -> tuple[str, list[str]]:
    """A page of a random layout, and the texts of its article's blocks in order."""
    pick = lambda *a: a[int(rng.integers(len(a)))]
    chance = lambda q: rng.random() < q
    word = lambda: VOCABULARY[int(rng.integers(len(VOCABULARY)))]

    def words(n):
        own = [word() for _ in range(max(1, n))]
        style = rng.random()
        if style < 0.08:
            own = [w.upper() + "!!" for w in own]
        elif style < 0.16:
            own = [w + pick("***", "###", "$$$", "%%%") for w in own]
        elif style < 0.26:
            own = [own[0]] * len(own)
        return " ".join(own)

    sentence = lambda: words(int(rng.integers(1, 25))).capitalize() + pick(".", ".", ".", "", "!", "?")
    paragraph = lambda: " ".join(sentence() for _ in range(int(rng.integers(1, 7)) * (20 if chance(0.02) else 1)))
    article: list[str] = []

    def named(tag, *names):
        attribute = pick("class", "id")
        return tag if chance(0.15) and tag not in ("div", "section", "p") else f'{tag} {attribute}="{pick(*names)}{pick("", "", "-1", " box", "-wrap", " clearfix")}"'

    def wrap(element, inner):
        return f"<{element}>{inner}</{element.split()[0]}>"

    def links(n, own="li"):
        return wrap(pick("ul", "ol") if own == "li" else "div", "".join(f'<{own}><a href="/{word()}">{words(int(rng.integers(1, 4)))}</a></{own}>' for _ in range(n)))

    def note(*cues):
        return pick(sentence(), f"{pick(*cues).capitalize()} {sentence()}", paragraph())

    def menu():
        return wrap(named(pick("nav", "nav", "div", "ul"), "menu", "navbar", "nav", "navigation", "main-menu", "breadcrumbs", "topnav"), links(int(rng.integers(2, 9)), pick("li", "li", "span", "div")))

    def header():
        return wrap(named(pick("header", "header", "div"), "header", "site-header", "masthead", "top", "page-header", "banner"), pick(f"<div>{words(3)}</div>", f"<p>{words(4)}</p>", menu(), f"<h1>{words(2)}</h1><p>{sentence()}</p>"))

    def footer():
        cue = pick("&copy; 2024 ", "Copyright ", "", "Impressum ", "&copy; www.example.com &middot; ")
        return wrap(named(pick("footer", "footer", "div"), "footer", "site-footer", "bottom", "colophon", "page-footer", "copyright"), pick(f"{cue}{sentence()}", f"<p>{cue}{sentence()}</p><p>{paragraph()}</p>", links(4) + f"<p>{cue}{sentence()}</p>"))

    def side():
        return wrap(named(pick("aside", "aside", "div", "section"), "sidebar", "side", "widget", "related", "rail", "recommended", "popular", "trending", "more", "teaser", "infobox"), pick(f"<h3>{words(2)}</h3>{links(4)}", f"<p>{note('read more')}</p>", f"<h2>{words(2)}</h2><p>{paragraph()}</p><p>{sentence()}</p>", links(3)))

    def advert():
        return wrap(named(pick("div", "div", "aside", "section", "p"), "ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "adbox", "sponsor", "promotion"), pick(note("advertisement", "sponsored", "buy now"), f"<p>{note('advertisement', 'offer')}</p>"))

    def notice():
        return wrap(named(pick("div", "div", "section", "dialog"), "cookie", "notice", "consent", "gdpr", "alert", "cookies-banner", "message", "popup", "modal", "overlay", "warning", "disclaimer", "privacy"), pick(f"<p>{note('we use cookies', 'this site uses cookies')}</p><button>{words(1)}</button>", note("cookies", "accept"), f"<div>{paragraph()}</div>"))

    def form():
        return wrap(pick("form", named("form", "newsletter", "search", "login", "subscribe", "signup", "contact")), pick(f"<label>{words(2)}</label><input><button>{words(1)}</button>", f"<p>{note('subscribe', 'sign up', 'search')}</p><input><button>{words(1)}</button>", f"<fieldset><legend>{words(2)}</legend><div>{sentence()}</div></fieldset>"))

    def comments():
        one = lambda: wrap(named(pick("div", "li", "article", "p"), "comment", "reply", "comment-body", "review"), pick(paragraph(), f"<p>{paragraph()}</p>", f"<h4>{words(2)}</h4><p>{sentence()}</p>"))
        return wrap(named(pick("section", "div", "div"), "comments", "discussion", "responses", "comment-list", "disqus", "replies", "reviews"), f"<h3>{words(2)}</h3>" * chance(0.6) + "".join(one() for _ in range(int(rng.integers(1, 5)))))

    def social():
        return wrap(named("div", "share", "social", "sharing", "tags", "byline", "meta", "pagination", "toolbar", "buttons"), pick(links(3, "span"), words(3)))

    extras = [advert, side, form, notice, social]
    entity = lambda s: s if chance(0.9) else s + pick("&amp;", " &quot;x&quot;", "&nbsp;y")

    def body():
        parts, open_p = [], chance(0.25)
        if chance(0.75):
            title = words(int(rng.integers(1, 10)))
            article.append(title)
            parts.append(wrap(pick("h1", "h1", "h2"), title))
        for _ in range(int(rng.integers(1, 14)) if chance(0.9) else 1):
            kind = rng.random()
            if kind < 0.68:
                s = entity(paragraph() if chance(0.8) else sentence() if chance(0.5) else word().capitalize() + ".")
                article.append(s)
                inner = pick(s, s, s, f"<b>{s}<br>", f"<em>{s}</em>")
                parts.append(f"<p>{inner}" if open_p or "<br>" in inner else wrap(pick("p", "p", "p", "p", "div", "blockquote"), inner))
            elif kind < 0.76:
                s = words(int(rng.integers(1, 6)))
                article.append(s)
                parts.append(wrap(pick("h2", "h3", "h4"), s))
            elif kind < 0.81:
                items = [sentence() for _ in range(int(rng.integers(2, 5)))]
                article.extend(items)
                parts.append(wrap(pick("ul", "ol"), "".join(f"<li>{s}</li>" for s in items)))
            elif kind < 0.84:
                items = [sentence() for _ in range(int(rng.integers(2, 5)))]
                article.extend(items)
                parts.append("<table>" + "".join(f"<tr><td>{s}</td></tr>" for s in items) + "</table>")
            else:
                parts.append(pick(*extras)())
        return "".join(parts)

    main = wrap(pick("article", "article", "article", "main", named("article", "post", "entry", "story"), named("div", "content", "post", "entry-content", "article-body", "story", "main-content", "post-body", "text", "page-content"), named("section", "article", "content", "story"), named("main", "content", "main")), body())
    for _ in range(int(rng.integers(0, 3))):
        main = wrap(pick("div", "main", named("div", "page", "wrapper", "container", "layout", "row", "main", "content", "site")), pick("", side(), advert()) * chance(0.4) + main + pick("", side(), comments(), social()) * chance(0.5))
    before = [f for f, q in ((header, 0.5), (menu, 0.8), (notice, 0.3), (advert, 0.5), (form, 0.2), (side, 0.2)) if chance(q)]
    after = [f for f, q in ((comments, 0.35), (side, 0.35), (advert, 0.3), (form, 0.2), (social, 0.2), (footer, 0.9), (notice, 0.15)) if chance(q)]
    if chance(0.3):
        rng.shuffle(before)
    if chance(0.12):  # nothing but the article
        before, after = [], []
    page = "".join(f() for f in before) + main + "".join(f() for f in after)
    return f"<!DOCTYPE html><html><head><title>{words(3)}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{page}</body></html>", article


@lru_cache(maxsize=1)
def labeller(pages: int = 1200) -> dict:
    """Weights fitted on made-up pages; the same in every run."""
    rng, vectors = np.random.default_rng(41), TextVectors()
    made = []
    for _ in range(pages):
        page, article = made_up_page(rng)
        own, wanted, y = blocks(page), [SPACE.sub(" ", entities.unescape(a)).strip() for a in article], []
        at = 0
        for _, text, _ in own:  # the article's blocks come in order
            hit = at < len(wanted) and text == wanted[at]
            at += hit
            y.append(float(hit))
        if at == len(wanted) and own:
            made.append((np.array([path_vector(b[0]) for b in own]), vectors(own), np.array(y, np.float32)))
    return train_labeller(made)


def extract(p: dict):
    """Function for ``on_texts``: the main text of pages."""

    def make():
        of_path: dict[tuple[str, ...], int] = {}
        text_vectors = TextVectors()
        gates = {d: np.zeros((0, 4 * UNITS), np.float32) for d in "fb"}

        def work(values: list[str]) -> dict:
            pages = [blocks(t) for t in values]
            flat = [b for page in pages for b in page]
            if len(of_path) > 50_000:
                of_path.clear()
                gates.update({d: g[:0] for d, g in gates.items()})
            new = [x for x in dict.fromkeys(b[0] for b in flat) if x not in of_path]
            if new:
                vectors = np.array([path_vector(x) for x in new])
                of_path.update(zip(new, range(len(of_path), len(of_path) + len(new))))
                for d in "fb":
                    gates[d] = np.concatenate((gates[d], vectors @ p[f"path_{d}"] + p[f"bias_{d}"]))
            lengths = np.array([len(page) for page in pages], np.int64)
            out = [""] * len(pages)
            if flat:
                at = np.array([of_path[b[0]] for b in flat])
                others = text_vectors(flat)
                main = margins(p, {d: gates[d][at] + others @ p[f"other_{d}"] for d in "fb"}, lengths) > 0
                first = 0
                for k, page in enumerate(pages):
                    out[k] = "\n\n".join(b[1] for b, keep in zip(page, main[first : first + len(page)]) if keep)
                    first += len(page)
            return {"text": out}

        return work

    return make


def extract_text(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text (main text, empty if none).

    Null and empty pages give an empty text; broken or cut-off markup is read as far as it
    goes. Rows are read one by one, so repeated rows and null ids stay as they are; other
    columns are not read.
    """
    d = pages.select(F.col("page_id"), F.col("url"), F.col("html").cast("string").alias("html"))
    return d.select("page_id", "url", on_texts(extract(labeller()), "text string", "html", 2_000_000).alias("t")).select("page_id", "url", "t.text")
