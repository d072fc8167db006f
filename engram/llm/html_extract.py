"""Main text of web pages by a linear-chain conditional random field over leaf blocks (operator 7).

A page's markup is read into leaf blocks (runs of text between block-level tags) with the tags and the
class and id words of their ancestors.  A block's features are its ancestors and its text's shape; a CRF
with the labels article and other is trained by stochastic gradient on labelled pages and decoded by
Viterbi.  The labelled pages are laid out here from a seed (:func:`labelled_pages`): many kinds of
blocks (prose, lists, tables, definitions, figures, boxes) in many page layouts, with and without a marked article,
each block with its label.

Defined results: a very long page is read whole; null or empty html, and pages without article blocks, give the empty text with 0
characters; scripts, styles and comments never are blocks; unclosed and stray tags are tolerated;
repeated rows stay repeated; other columns are not read.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sparktools import bare
from .words import slices

LABELLED_PAGES, EPOCHS, SEED = 400, 8, 7

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|select|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MARKED = frozenset("article aside blockquote body button dialog dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header label li main nav ol option p pre section table td th title ul".split())
#: Words of class and id attributes that say what a container is for.
_HINTS = frozenset(
    "ad ads advert advertisement article banner body breadcrumb breadcrumbs byline comment comments consent content cookie copyright disqus entry feedback foot footer "
    "form header main masthead menu meta nav navbar navigation newsletter notice pagination popup post promo recommended related replies reply respond share sidebar social sponsor sponsored story subscribe tags text toolbar widget".split()
)
_SPLIT = re.compile(r"[^a-z0-9]+")


def leaf_blocks(page: str) -> list[tuple[str, tuple[str, ...], int]]:
    """(text, ancestor marks from the outside in, characters inside links) of each non-empty leaf block."""
    blocks: list[tuple[str, tuple[str, ...], int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    run: list[str] = []
    linked = in_link = 0

    def close() -> None:
        nonlocal linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                blocks.append((text, tuple(m for _, marks in stack for m in marks), linked))
            run.clear()
        linked = 0

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at:
            piece = page[at : token.start()]
            run.append(piece)
            if in_link:
                linked += len(piece)
        at = token.end()
        tag = token[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _INLINE:
            if tag == "br":
                run.append(" ")
            elif tag == "a":
                in_link = 0 if token[2] else 1
            continue
        close()
        in_link = 0
        if token[2]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    del stack[depth:]
                    break
        elif tag not in _VOID:
            if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == tag:
                stack.pop()
            marks = [tag] if tag in _MARKED else []
            if "=" in token[4]:
                for names in _NAMES.findall(token[4]):
                    marks += [f".{w}" for w in _SPLIT.split("".join(names).lower()) if w in _HINTS]
            if not token[4].rstrip().endswith("/"):
                stack.append((tag, tuple(marks)))
    if at < len(page):
        run.append(page[at:])
    close()
    return blocks


_CONTAINERS = frozenset(("article", "main", ".content", ".article", ".post", ".entry", ".story", ".body", ".text"))


def features(blocks: list[tuple[str, tuple[str, ...], int]]) -> list[list[str]]:
    out = []
    inside = [not _CONTAINERS.isdisjoint(marks) for _, marks, _ in blocks]
    marked = any(inside)
    for i, (text, marks, linked) in enumerate(blocks):
        n = len(text)
        found = ["bias", *{f"in {m}" for m in marks}, f"length {min(8, n.bit_length())}", f"links {0 if not linked else min(4, 1 + 4 * linked // max(n, 1))}"]
        if marks:
            found.append(f"inner {marks[-1]}")
        if marked:
            found.append("inside" if inside[i] else "outside")
        else:
            found += ["unmarked page", f"unmarked, length {min(8, n.bit_length())}", f"unmarked, inner {marks[-1] if marks else 'none'}", f"unmarked, links {0 if not linked else min(4, 1 + 4 * linked // max(n, 1))}"]
        found.append(f"stops {min(3, text.count('.') + text.count('!') + text.count('?'))}")
        if "©" in text:
            found.append("copyright")
        if i == 0:
            found.append("first")
        if i == len(blocks) - 1:
            found.append("last")
        out.append(found)
    return out


class ChainField:
    """Linear-chain CRF with two labels; weights by feature name."""

    def __init__(self) -> None:
        self.weights: dict[str, np.ndarray] = {}
        self.steps = np.zeros((2, 2))

    def _scores(self, rows: list[list[str]]) -> np.ndarray:
        zero = np.zeros(2)
        return np.array([sum((self.weights.get(f, zero) for f in row), zero) for row in rows])

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = 0.2, decay: float = 1e-4, seed: int = SEED) -> ChainField:
        order = random.Random(seed)
        for epoch in range(epochs):
            order.shuffle(pages)
            step = rate / (1 + epoch)
            for rows, labels in pages:
                if not rows:
                    continue
                scores = self._scores(rows)
                n = len(rows)
                ahead, back = np.empty((n, 2)), np.zeros((n, 2))
                ahead[0] = scores[0]
                for i in range(1, n):
                    ahead[i] = scores[i] + np.logaddexp(*(ahead[i - 1][:, None] + self.steps))
                for i in range(n - 2, -1, -1):
                    back[i] = np.logaddexp(*(self.steps + scores[i + 1] + back[i + 1]).T)
                total = np.logaddexp(*ahead[-1])
                slope = -np.exp(ahead + back - total)
                slope[np.arange(n), labels] += 1
                moved = np.zeros((2, 2))
                for i in range(1, n):
                    moved -= np.exp(ahead[i - 1][:, None] + self.steps + scores[i] + back[i] - total)
                    moved[labels[i - 1], labels[i]] += 1
                for row, g in zip(rows, slope, strict=True):
                    for f in row:
                        w = self.weights.get(f)
                        self.weights[f] = step * g if w is None else w * (1 - step * decay) + step * g
                self.steps += step * moved
        return self

    def compact(self) -> dict:
        """Plain numbers for decoding: the preference for label 1 of each feature, and of each step."""
        return {"lean": {f: float(w[1] - w[0]) for f, w in self.weights.items()}, "steps": self.steps.tolist()}


def decode(model: dict, rows: list[list[str]]) -> list[int]:
    """Viterbi."""
    lean, ((s00, s01), (s10, s11)) = model["lean"].get, model["steps"]
    if not rows:
        return []
    other, article, back = 0.0, sum(lean(f, 0.0) for f in rows[0]), []
    for row in rows[1:]:
        own = sum(lean(f, 0.0) for f in row)
        o0, o1, a0, a1 = other + s00, article + s10, other + s01, article + s11
        back.append((o1 > o0, a1 > a0))
        other, article = max(o0, o1), max(a0, a1) + own
    label = int(article > other)
    out = [label]
    for step in reversed(back):
        label = int(step[label])
        out.append(label)
    return out[::-1]


def labelled_pages(count: int = LABELLED_PAGES, seed: int = SEED) -> list[tuple[str, list[int]]]:
    """(html, label of each leaf block) of pages in many layouts, from a seed."""
    rng = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice("aeioulnrstdmk") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(low, high)))

    def prose(low: int = 1, high: int = 90) -> str:
        text = words(low, high).split()
        for i in range(rng.randint(4, 12), len(text), rng.randint(5, 14)):
            text[i] += rng.choice((".", ",", ".", "?", "!!", "***"))
        return " ".join(text).capitalize() + rng.choice((".", ".", ""))

    def link(low: int = 1, high: int = 3) -> str:
        return f'<a href="/{words(1, 1)}">{words(low, high)}</a>'

    def listed(tag: str, name: str = "") -> list[tuple[str, int | None]]:
        parts: list[tuple[str, int | None]] = [(f"<{tag}{name}><ul>", None)]
        parts += [(f"<li>{link()}</li>", 0) for _ in range(rng.randint(2, 9))]
        return [*parts, (f"</ul></{tag}>", None)]

    def boxed(tag: str, name: str, low: int = 2, high: int = 30) -> list[tuple[str, int | None]]:
        return [(f'<{tag}{name}>{prose(low, high)}</{tag}>', 0)]

    def form() -> list[tuple[str, int | None]]:
        return [("<form>", None), (f"<label>{words(1, 4)}</label>", 0), ('<input name="q">', None), (f"<button>{words(1, 2)}</button>", 0), ("</form>", None)]

    def remarks() -> list[tuple[str, int | None]]:
        parts: list[tuple[str, int | None]] = [(f'<{(t := rng.choice(("section", "div")))} class="comments">', None), (f"<h3>{words(1, 2)}</h3>", 0)]
        parts += [(f'<div class="comment"><p>{prose(3, 60)}</p></div>', 0) for _ in range(rng.randint(1, 5))]
        return [*parts, (f"</{t}>", None)]

    def table() -> list[tuple[str, int | None]]:
        wide, parts = rng.randint(1, 4), [("<table>", None)]
        for r in range(rng.randint(1, 5)):
            parts.append(("<tr>", None))
            cell = "th" if r == 0 and rng.random() < 0.5 else "td"
            parts += [(f"<{cell}>{words(1, 6)}</{cell}>", 1) for _ in range(wide)]
            parts.append(("</tr>", None))
        return [*parts, ("</table>", None)]

    def definitions() -> list[tuple[str, int | None]]:
        parts: list[tuple[str, int | None]] = [("<dl>", None)]
        for _ in range(rng.randint(1, 4)):
            parts += [(f"<dt>{words(1, 4)}</dt>", 1), (f"<dd>{prose(3, 30)}</dd>", 1)]
        return [*parts, ("</dl>", None)]

    def article(marked: bool) -> list[tuple[str, int | None]]:
        if marked:
            tag, name = rng.choice((("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="article-body"'), ("section", ' class="story"')))
        else:
            tag, name = rng.choice((("div", ""), ("div", ' id="page"'), ("div", ' class="column"'), ("section", ""), ("center", "")))
        title = prose(3, 14)
        parts: list[tuple[str, int | None]] = [(f"<{tag}{name}>", None)]
        if rng.random() < 0.8:
            parts.append((f"<h1>{title}</h1>", 1))
        paragraph = rng.choice(("p", "p", "p", "div"))
        for i in range(rng.randint(1, 12)):
            kind = rng.random()
            if kind < 0.64:
                text = prose() if rng.random() < 0.85 else f"{prose(3, 20)} {link()} {prose(3, 20)}"
                parts.append((f"<{paragraph}>{text}</{paragraph}>" if paragraph == "div" or rng.random() < 0.8 else f"<p><b>{text}<br>", 1))
            elif kind < 0.7:
                parts.append((f"<h{rng.randint(2, 4)}>{words(1, 6)}</h2>", 1))
            elif kind < 0.74:
                parts.append((f"<blockquote>{prose(5, 40)}</blockquote>", 1))
            elif kind < 0.79:
                parts += [("<ul>", None), *[(f"<li>{prose(3, 15)}</li>", 1) for _ in range(rng.randint(1, 4))], ("</ul>", None)]
            elif kind < 0.84:
                parts += table()
            elif kind < 0.87:
                parts += definitions()
            elif kind < 0.89:
                parts += [("<figure><img src='x'>", None), (f"<figcaption>{prose(3, 15)}</figcaption>", 1), ("</figure>", None)]
            elif kind < 0.93 and i:
                parts += boxed("div", rng.choice((' class="ad"', ' class="share"', ' class="related"', ' class="newsletter"')))
            elif kind < 0.96 and i:
                parts += boxed("aside", "")
            else:
                parts += [("<pre>", None), (words(3, 20), 1), ("</pre>", None)]
        return [*parts, (f"</{tag}>", None)]

    pages = []
    for _ in range(count):
        parts: list[tuple[str, int | None]] = [("<html><head>", None), (f"<title>{prose(2, 12)}</title>", 0), ("<style>p{}</style></head><body>", None)]
        before = [lambda: listed("nav"), lambda: listed("div", ' class="menu"'), lambda: boxed("header", ""), lambda: boxed("div", ' class="ad"'), lambda: boxed("div", ' class="cookie-notice"'), form, lambda: listed("aside", ' class="sidebar"'), lambda: boxed("div", ' class="banner"')]
        after = [lambda: boxed("footer", ""), lambda: boxed("div", ' id="footer"'), remarks, lambda: listed("aside"), lambda: boxed("div", ' class="sidebar"', 5, 50), lambda: boxed("div", ' class="ad"'), lambda: listed("div", ' class="related"'), form, lambda: boxed("div", ' class="copyright"')]
        for make in rng.sample(before, rng.randint(1, 5)):
            parts += make()
        if rng.random() < 0.97:
            parts += article(rng.random() < 0.65)
        for make in rng.sample(after, rng.randint(1, 5)):
            parts += make()
        if rng.random() < 0.4:
            parts.append((f"<footer>&copy; {words(1, 3)} &middot; {prose(3, 9)}</footer>", 0))
        if rng.random() < 0.9:
            parts.append(("</body></html>", None))
        labels = [label for text, label in parts if label is not None]
        page = "".join(text for text, _ in parts)
        if len(leaf_blocks(page)) == len(labels):
            pages.append((page, labels))
    return pages


_models: dict[tuple[int, int], dict] = {}


def trained(count: int = LABELLED_PAGES, seed: int = SEED) -> dict:
    if (count, seed) not in _models:
        pages = [(features(leaf_blocks(page)), labels) for page, labels in labelled_pages(count, seed)]
        _models[count, seed] = ChainField().fit(pages).compact()
    return _models[count, seed]


def main_text(model: dict, page: str | None) -> str:
    blocks = leaf_blocks(page or "")
    return " ".join(b[0] for b, label in zip(blocks, decode(model, features(blocks)), strict=True) if label)


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", markup: str = "html", model: dict | None = None) -> DataFrame:
    """One row per page: key, url, text, n_chars."""
    model = trained() if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(model, page) for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    rows = bare(pages, key, url, markup).toDF("page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long").withColumnRenamed("page_id", key).withColumnRenamed("url", url)
