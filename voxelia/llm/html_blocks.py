"""Main text of web pages by a recurrent block labeller.

A page is read into a sequence of leaf blocks, each with its tag path, its words and its link share. A
small bidirectional LSTM in numpy, trained here on generated pages with known labels, reads the whole
sequence and labels every block; the main text is the blocks labelled as content, in page order.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Tags that end a block of text, tags whose text is never shown, tags without an end tag.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
HIDDEN_TAGS = frozenset("script style head title noscript template textarea svg iframe object".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Tags that a head may hold; any other start tag closes an open head.
HEAD_TAGS = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
#: A start tag closes an open tag of these kinds (optional end tags).
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
PATH_SLOTS, WORD_SLOTS = 16384, 32768
#: What joins the parts of a class or id.
PARTS = re.compile(r"[-_:.0-9]+")


class Blocks(HTMLParser):
    """Collects (path tokens, text, link share) for every leaf block with text. Path tokens are the different
    tags, classes, ids and roles of all open elements, and the parts of these names, kept as elements open and
    close; nesting of like elements adds nothing to them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.count: Counter[str] = Counter()  # open elements by tag
        self.tokens: dict[str, int] = {}  # open elements by path token
        self.found: list[tuple[list[str], str, float]] = []
        self.parts: list[str] = []
        self.linked = self.hidden = self.links = 0
        self.path: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.found.append((self.path, text, min(1.0, self.linked / len(text))))
        self.parts, self.linked, self.path = [], 0, []

    def pop(self, tags) -> None:
        while self.open:
            tag, names = self.open.pop()
            self.count[tag] -= 1
            for t in (tag, *names):
                if self.tokens[t] == 1:
                    del self.tokens[t]
                else:
                    self.tokens[t] -= 1
            self.hidden -= tag in HIDDEN_TAGS
            self.links -= tag == "a"
            if tag in tags:
                return

    def end_head(self) -> None:
        if self.open and self.open[-1][0] == "head":
            self.pop({"head"})

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD_TAGS:
            self.end_head()
        if tag == "br":
            self.parts.append(" ")
        if tag in BLOCK_TAGS:
            self.flush()
            stale = CLOSES.get(tag, {"p"})
            while any(t in stale for t, _ in self.open[-4:]) and not (tag == "li" and self.open[-1][0] in ("ul", "ol")):
                at = next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] in stale)  # one of the last four
                near = self.open[at][0]
                if any(t in ("div", "article", "section", "table", "ul", "ol", "td") and t not in stale for t, _ in self.open[at:]):
                    break
                self.pop({near})
        if tag in VOID_TAGS:
            return
        said = dict.fromkeys(x for k, v in attrs if k in ("class", "id", "role") and v for x in v.lower().split())
        names = tuple(dict.fromkeys([*(f"{tag}.{x}" for x in said), *(f"~{y}" for x in said for y in PARTS.split(x) if y)]))
        self.open.append((tag, names))
        for t in (tag, *names):
            self.tokens[t] = self.tokens.get(t, 0) + 1
        self.count[tag] += 1
        self.hidden += tag in HIDDEN_TAGS
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        if tag not in HEAD_TAGS:
            self.end_head()
        if tag == "br":
            self.parts.append(" ")
        elif tag in BLOCK_TAGS:
            self.flush()

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.flush()
        if self.count[tag]:
            self.pop({tag})

    def handle_data(self, data):
        if data.strip():
            self.end_head()
        if self.hidden:
            return
        if not self.path and data.strip():
            self.path = list(self.tokens)
        self.parts.append(data)
        if self.links:
            self.linked += len(data)


def blocks(html: str | None) -> list[tuple[list[str], str, float]]:
    reader = Blocks()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return reader.found


def slots(tokens, size: int) -> list[int]:
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) % size for t in tokens] or [0]


def features(found) -> tuple:
    """Flat path slots, path sizes, flat word slots, word sizes, and numbers of one page's blocks."""
    paths = [slots(p, PATH_SLOTS) for p, _, _ in found]
    words = [slots(dict.fromkeys(t.lower().split()), WORD_SLOTS) for _, t, _ in found]  # a word that repeats says nothing more
    numbers = [(np.log1p(len(t)) / 6, share, float(t[-1] in ".!?"), 1.0) for _, t, share in found]
    return paths, words, np.array(numbers)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM over block vectors; weights is a dict of arrays."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @staticmethod
    def start(width: int = 16, hidden: int = 16, seed: int = 7) -> Labeller:
        r = np.random.default_rng(seed)
        into = width * 2 + 4
        w = {"path": r.normal(0, 0.3, (PATH_SLOTS, width)), "word": r.normal(0, 0.05, (WORD_SLOTS, width)), "out": r.normal(0, 0.2, 2 * hidden + into), "bias": np.zeros(1)}
        for side in "fb":
            w[f"x{side}"] = r.normal(0, 0.2, (into, 4 * hidden))
            w[f"h{side}"] = r.normal(0, 0.2, (hidden, 4 * hidden))
            w[f"c{side}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
        return Labeller(w)

    def vectors(self, page) -> np.ndarray:
        paths, words, numbers = page
        bag = lambda table, lists: np.add.reduceat(table[np.concatenate(lists)], np.cumsum([0, *map(len, lists[:-1])]), 0)
        word = bag(self.w["word"], words) / np.sqrt([len(x) for x in words])[:, None]
        return np.concatenate([bag(self.w["path"], paths) / 3, word, numbers], 1)

    def scan(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool):
        """x: (batch, time, in). Hidden states and, with keep, what the way back needs."""
        n, t, _ = x.shape
        h = c = np.zeros((n, self.w[f"h{side}"].shape[0]))
        given = x @ self.w[f"x{side}"] + self.w[f"c{side}"]
        states, kept = np.zeros((n, t, h.shape[1])), []
        for k in range(t) if side == "f" else range(t - 1, -1, -1):
            i, f, o, g = np.split(given[:, k] + h @ self.w[f"h{side}"], 4, 1)
            i, f, o, g = sigmoid(i), sigmoid(f), sigmoid(o), np.tanh(g)
            m = mask[:, k, None]
            new_c = np.where(m, f * c + i * g, c)
            new_h = np.where(m, o * np.tanh(new_c), h)
            if keep:
                kept.append((k, h, c, i, f, o, g, new_c, m))
            h, c = new_h, new_c
            states[:, k] = h
        return states, kept

    def forward(self, pages: list, keep: bool = False):
        xs = [self.vectors(p) for p in pages]
        t = max(map(len, xs))
        x, mask = np.zeros((len(xs), t, xs[0].shape[1])), np.zeros((len(xs), t), bool)
        for k, v in enumerate(xs):
            x[k, : len(v)], mask[k, : len(v)] = v, True
        forth, kept_f = self.scan(x, mask, "f", keep)
        back, kept_b = self.scan(x, mask, "b", keep)
        joint = np.concatenate([forth, back, x], 2)
        return sigmoid(joint @ self.w["out"] + self.w["bias"]), (x, mask, joint, kept_f, kept_b)

    def gradients(self, pages: list, labels: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        p, (x, mask, joint, kept_f, kept_b) = self.forward(pages, True)
        y = np.zeros_like(p)
        for k, v in enumerate(labels):
            y[k, : len(v)] = v
        total = mask.sum()
        loss = -float((mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / total)
        d = mask * (p - y) / total
        g = {"out": np.einsum("nt,ntd->d", d, joint), "bias": np.array([d.sum()])}
        wide = self.w["hf"].shape[0]
        dj = d[:, :, None] * self.w["out"]
        dx = dj[:, :, 2 * wide :].copy()
        for side, kept, dh_all in (("f", kept_f, dj[:, :, :wide]), ("b", kept_b, dj[:, :, wide : 2 * wide])):
            wx, wh = self.w[f"x{side}"], self.w[f"h{side}"]
            gx, gh, gc = np.zeros_like(wx), np.zeros_like(wh), np.zeros(wx.shape[1])
            dh = dc = np.zeros((len(pages), wide))
            for k, h, c, i, f, o, gg, new_c, m in reversed(kept):
                dh = dh + dh_all[:, k]
                th = np.tanh(new_c)
                dcell = dc + dh * o * (1 - th**2)
                gate = np.concatenate([dcell * gg * i * (1 - i), dcell * c * f * (1 - f), dh * th * o * (1 - o), dcell * i * (1 - gg**2)], 1) * m
                gx += x[:, k].T @ gate
                gh += h.T @ gate
                gc += gate.sum(0)
                dx[:, k] += gate @ wx.T
                dh = np.where(m, gate @ wh.T, dh)
                dc = np.where(m, dcell * f, dc)
            g |= {f"x{side}": gx, f"h{side}": gh, f"c{side}": gc}
        width = self.w["path"].shape[1]
        g["path"], g["word"] = np.zeros_like(self.w["path"]), np.zeros_like(self.w["word"])
        for k, (paths, words, _) in enumerate(pages):
            for s, own in enumerate(paths):
                np.add.at(g["path"], own, dx[k, s, :width] / 3)
            for s, own in enumerate(words):
                np.add.at(g["word"], own, dx[k, s, width : 2 * width] / np.sqrt(len(own)))
        return loss, g


SYLLABLES = "an be co da en fu ga he in jo ka lo me nu or pa qui re so ta un ver wi xe yo zu".split()
#: Names that pages give to what isn't their article, and words that it says, by kind; the names meet in pairs, too.
NAMES = {
    "nav": "nav menu navigation navbar breadcrumbs breadcrumb topbar toolbar pagination pager tabs skip sitemap",
    "header": "header masthead branding banner site-header page-header logo tagline topline",
    "footer": "footer site-footer colophon bottom copyright legal imprint credits page-footer",
    "ad": "ad ads advert advertisement banner sponsored sponsor promo adslot dfp outbrain taboola commercial",
    "side": "sidebar side related widget widgets aside rail recommended trending popular teaser more-stories secondary tags share social",
    "notice": "cookie cookies notice consent popup alert gdpr modal overlay dialog banner toast message privacy paywall subscribe newsletter",
    "comments": "comments comment comment-list discussion replies reply disqus disqus_thread respond thread responses reviews feedback commentary",
    "form": "form search searchbox login signup subscribe newsletter contact-form register",
}
ROLES = {"nav": "navigation menu menubar", "header": "banner", "footer": "contentinfo", "ad": "complementary", "side": "complementary", "notice": "dialog alertdialog alert status", "comments": "feed log", "form": "search form"}
SAYINGS = {
    "nav": "home about contact menu search login news sports help", "header": "welcome menu log in search home", "footer": "copyright all rights reserved terms privacy policy imprint contact",
    "ad": "advertisement sponsored buy now sale offer shop", "side": "related most read more stories share follow us trending", "notice": "we use cookies accept all reject settings privacy consent close",
    "comments": "reply says posted by likes report commented days ago", "form": "email password submit subscribe your name send search sign up",
}


def made_page(r: random.Random) -> tuple[str, list[bool]]:
    """A generated page and, for each of its blocks in order, whether it is content."""
    out, labels = [], []

    def invented(n: int = 3) -> str:
        return "".join(r.choices(SYLLABLES, k=n))

    def say(least: int, most: int, kind: str = "") -> str:
        words = [invented(r.randint(1, 4)) for _ in range(r.randint(least, most))]
        if kind and r.random() < 0.5:
            words = [*r.choices(SAYINGS[kind].split(), k=r.randint(1, 6)), *words[: r.choice([0, 3, 40])]]
        elif not kind and r.random() < 0.1:  # an article may use such words, too
            words.insert(r.randint(0, len(words)), r.choice(SAYINGS[r.choice(list(SAYINGS))].split()))
        return " ".join(words) + r.choice(["", ".", ".", "&amp;", "!"])

    def leaf(tag: str, content: bool, least: int, most: int, link: bool = False, kind: str = "") -> None:
        text = say(least, most, kind)
        text = f'<a href="/x">{text}</a>' if link else text
        text = f"<b>{text}" + r.choice(["</b>", "<br>"]) if r.random() < 0.1 else text
        names = f' class="{invented()}"' if r.random() < 0.1 else ""
        out.append(f"<{tag}{names}>{text}" + (f"</{tag}>" if tag != "p" or r.random() < 0.8 else ""))
        labels.append(content)

    def named(tag: str, names: str, role: str = "") -> tuple[str, str]:
        key, name = r.choice(["class", "id"]), r.choice(names.split())
        if r.random() < 0.3:  # a name of several parts, of which one tells
            name = r.choice(["-", "_"]).join(r.sample([name, invented(2)], 2) if r.random() < 0.7 else [name, r.choice(names.split())])
        if key == "class" and r.random() < 0.2:
            name = " ".join([*(invented() for _ in range(r.randint(1, 6))), name])
        more = f' role="{r.choice(role.split())}"' if role and r.random() < 0.3 else ""
        return f'<{tag} {key}="{name}"{more}>', f"</{tag}>"

    def listed(links: bool, content: bool, kind: str = "") -> None:
        shape = "ul" if not content else r.choice(["ul", "ol", "dl", "table"])
        out.append(f"<{shape}>")
        for _ in range(r.randint(2, 8)):
            if shape == "dl":
                leaf("dt", content, 1, 4)
                leaf("dd", content, 1, 25)
            elif shape == "table":
                out.append("<tr>")
                for _ in range(r.randint(1, 3)):
                    leaf(r.choice(["td", "td", "th"]), content, 1, 5)
                out.append("</tr>")
            else:
                leaf("li", content, 1, 4 if links else 15, links, kind)
        out.append(f"</{shape}>")

    def noise() -> None:
        kind = r.choice("nav header footer ad ad side notice form comments comments".split())
        if kind == "nav":
            # a list of links alone is no article, whatever it is called
            start, end = r.choice([("<nav>", "</nav>"), ("<nav>", "</nav>"), named("div", NAMES[kind], ROLES[kind]), named("ul", NAMES[kind], ROLES[kind]), named("div", invented()), ("<div>", "</div>")])
            out.append(start)
            listed(True, False, kind)
            out.append(end)
        elif kind in ("header", "footer"):
            start, end = r.choice([(f"<{kind}>", f"</{kind}>"), named("div", NAMES[kind], ROLES[kind])])
            out.append(start)
            for _ in range(r.randint(1, 3)):
                leaf(r.choice(["p", "div"]), False, 1, 12, r.random() < 0.4, kind)
            out.append(end)
        elif kind == "form":
            start, end = r.choice([("<form>", "</form>"), ("<form>", "</form>"), tuple(a + b for a, b in zip(named("div", NAMES[kind], ROLES[kind]), ("<form>", ""), strict=True))])
            out.append(start)
            leaf(r.choice(["label", "p", "div", "legend"]), False, 1, 8, False, kind)
            out.append('<input type="text"><button>' + say(1, 2, kind) + "</button>" + ("</form>" if "<form>" in start and start != "<form>" else "") + end)
            labels.append(False)
        else:
            start, end = r.choice([named("div", NAMES[kind], ROLES[kind]), named("section", NAMES[kind], ROLES[kind]), ("<aside>", "</aside>") if kind == "side" else ("<dialog open>", "</dialog>") if kind == "notice" else named(r.choice(["div", "ol", "ul"]), NAMES[kind], ROLES[kind])])
            out.append(start)
            deep = r.randint(1, 12) if r.random() < 0.3 else 0  # as in threads of replies
            inside = r.choice(["<div>", "<ul><li>", "<div><ul><li>", "<article>"] if kind == "comments" else ["<div>", "<ul><li>", "<div><ul><li>"])
            out.append(inside * deep)
            if r.random() < 0.4:
                out.append(say(2, 40, kind))
                labels.append(False)
            else:
                for _ in range(r.randint(1, 4)):
                    leaf(r.choice(["p", "div", "h3"]), False, 1, 40, r.random() < 0.2, kind)
            out.append("".join(f"</{t}>" for t in reversed(inside[1:-1].split("><"))) * deep)
            out.append(end)

    head = r.choice(["<title>t</title><style>p{margin:0}</style><script>var t=\"</p>\";</script>", "", '<meta charset="utf-8"><title>' + say(1, 6) + "</title>"])
    out.append(r.choice(["<!DOCTYPE html>", ""]) + r.choice([f"<html><head>{head}</head><body>", f'<html lang="en"><head>{head}</head><body class="{invented()}">', f"<head>{head}<body>"]))
    for _ in range(r.randint(0, 4)):
        noise()
    own = "content post article entry main-content post-body story article-body body text prose single page-content"
    start, end = r.choice([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main>", "</main>"), named("div", own), named("section", own), ("<main><article>", "</article></main>"), named("article", own), named("div", "main page-body text container"), ("<div><div>", "</div></div>"), ("<section>", "</section>"), ("<div><section>", "</section></div>"), named("section", invented(2)), named("div", invented(2)), ('<div role="main">', "</div>")])
    if r.random() < 0.15:
        wrap = named("div", "main page wrap wrapper container layout grid row col app root site")
        start, end = wrap[0] + start, end + wrap[1]
    if r.random() < 0.97:
        out.append(start)
        if r.random() < 0.8:
            leaf(r.choice(["h1", "h2"]), True, 1, 30)
        for _ in range(r.randint(1, 14)):
            if r.random() < 0.06:
                noise()
            elif r.random() < 0.12:
                listed(False, True)
            else:
                leaf(r.choice(["p"] * 9 + ["h2", "blockquote", "pre", "figcaption"]), True, 1, r.choice([3, 40, 120]), r.random() < 0.03)
        out.append(end)
    for _ in range(r.randint(0, 4)):
        noise()
    return "".join(out) + r.choice(["", "</body></html>"]), labels


@lru_cache(maxsize=2)
def trained(n_pages: int = 2200, epochs: int = 4, seed: int = 11) -> Labeller:
    """A labeller fitted to n_pages generated pages, a bound that no input changes. Deterministic."""
    r, model = random.Random(seed), Labeller.start()
    data = []
    while len(data) < n_pages:
        html, labels = made_page(r)
        found = blocks(html)
        if found and len(found) == len(labels):
            data.append((features(found), np.array(labels, float)))
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    step = 0
    for epoch in range(epochs):
        r.shuffle(data)
        for at in range(0, len(data), 25):
            part = data[at : at + 25]
            _, g = model.gradients([p for p, _ in part], [y for _, y in part])
            step += 1
            rate = 0.02 * 0.5**epoch * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, v in g.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                model.w[k] -= rate * first[k] / (np.sqrt(second[k]) + 1e-8)
    return model


def main_texts(model: Labeller, pages: list[str | None], group: int = 64) -> list[str]:
    """The main text of every page; pages of like length are read together."""
    found = [blocks(h) for h in pages]
    out = [""] * len(pages)
    order = sorted((k for k in range(len(pages)) if found[k]), key=lambda k: len(found[k]))
    at = 0
    while at < len(order):
        size = max(1, min(group, 20_000 // len(found[order[min(at + group, len(order)) - 1]])))
        own = order[at : at + size]
        p, _ = model.forward([features(found[k]) for k in own])
        for row, k in enumerate(own):
            out[k] = "\n".join(b[1] for b, score in zip(found[k], p[row], strict=False) if score >= 0.5)
        at += size
    return out


def extract(pages: DataFrame, model: Labeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text): one row per input row.

    Null, empty or tag-only html gives an empty text. Repeated rows give repeated rows; other columns are
    dropped. Rows are independent, so there is no shuffle and memory is bounded by one Arrow batch.
    """
    weights = (model or trained()).w
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col)) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller(weights)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = pa.array(main_texts(own, part.column(2).to_pylist()), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], names=[id_col, url_col, "text"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, schema)
