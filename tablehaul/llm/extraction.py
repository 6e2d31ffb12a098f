"""Main text of web pages by a tree-structured graphical model over the DOM.

A node is content or not. Node potentials come from a node's own features, edge potentials from the pair of a parent's
and a child's state. Sums of products go up from the leaves and down from the root, which gives every node its exact
marginal; the text blocks whose marginal is at least one half are the main text. The weights are fitted to labelled
pages by maximum likelihood, with the same message passing for the gradient. All pages of a batch are one forest, so
that messages of one depth are a few array operations.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehaul.llm.common import map_rows, text_bytes
from tablehaul.llm.labelled_pages import labelled_page

# Labelled pages that the model is fitted to.
TRAINING_PAGES = 390

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
# A quote counts after "=" if it is closed; otherwise a tag ends at its first ">".
_ATTRIBUTES = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+""")
_COMMENT_END = re.compile(r"--!?>")
# The text of these goes on to the end of the page if they are not closed; that of the others only counts as theirs if
# they are closed. What stands in noscript is text.
_RAW = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*+>?", re.I) for n in ("script", "style", "textarea", "title")}
_SKIPPED = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*+>", re.I) for n in ("template", "iframe", "svg")}
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")

# Elements that stand for a node; all others are part of the running text.
_BLOCKS = frozenset(
    "html body div p article section main nav header footer aside h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody "
    "tfoot tr td th blockquote pre figure figcaption form fieldset address details summary dialog menu center "
    "button select label option legend hr head".split()
)
_VOID = frozenset("hr".split())
# An element that opens closes these if they are open, up to the element that holds both.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
_TAG_KINDS = {
    **dict.fromkeys(("article", "main"), "article"), **dict.fromkeys(("nav", "menu"), "nav"), "header": "header",
    "footer": "footer", "aside": "aside", **dict.fromkeys(("form", "fieldset", "button", "select", "label", "option", "legend", "dialog"), "form"),
    "p": "p", **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "heading"), "li": "li", **dict.fromkeys(("ul", "ol"), "list"),
    **dict.fromkeys(("blockquote", "pre", "figure", "figcaption", "dl", "dt", "dd"), "quote"), "div": "div", "section": "section",
    **dict.fromkeys(("table", "thead", "tbody", "tfoot", "tr", "td", "th"), "table"), "head": "head", "text": "text",
}
# Words in a class, id or role and what they hint at.
_HINTS = {
    "content": "article content post entry story main body text page blog news prose",
    "menu": "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager toc skip links tabs",
    "frame": "header footer topbar subfooter masthead copyright legal bottom top branding contentinfo",
    "side": "sidebar side aside widget rail related recommended more popular trending complementary",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted dfp adsense",
    "notice": "cookie cookies notice notices disclaimer banner consent gdpr alert popup modal overlay dialog warning privacy newsletter subscribe signup subscription",
    "comment": "comment comments commentlist reply replies respond disqus discussion feedback reviews",
    "form": "form search login share social sharing buttons button tools toolbar rating",
}
_HINT_OF = {word: kind for kind, words in _HINTS.items() for word in words.split()}
_KINDS = sorted(set(_TAG_KINDS.values()))
_HINT_NAMES = sorted(_HINTS)
FEATURES = 1 + len(_KINDS) + 2 * len(_HINT_NAMES) + 8


@lru_cache(maxsize=4096)
def _hints(attributes: str) -> tuple[int, ...]:
    words = set()
    for found in _NAMES.finditer(attributes):
        value = next(g for g in found.groups() if g is not None)
        spaced = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()
        words.update(re.split(r"[^a-z]+", spaced))
    return tuple(sorted({_HINT_NAMES.index(_HINT_OF[w]) for w in words if w in _HINT_OF}))


@dataclass
class Page:
    """Nodes in document order, parents first: parent number, kind, hints, and the text of text blocks."""

    parents: list[int]
    kinds: list[str]
    hints: list[tuple[int, ...]]
    texts: list[str | None]
    linked: list[int]
    offsets: list[int]


def tags(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(begin, end, name, is it an end tag, attributes) of what is no text, in order: tags, and without a name comments and
    elements whose content does not count. Each character is looked at a few times at most, however broken the page is."""
    last_end, at = source.rfind(">"), 0
    unclosed = False
    lower = source.lower() if len(source.lower()) == len(source) else source
    last_close = {n: lower.rfind(f"</{n}") for n in _SKIPPED}
    while (at := source.find("<", at)) >= 0:
        found = _TAG.match(source, at)
        if not found:
            following = source[at + 1 : at + 2]
            if source.startswith("<!--", at):
                if source.startswith((">", "->"), at + 4):
                    end = source.index(">", at) + 1
                else:
                    closed = _COMMENT_END.search(source, at + 4)
                    end = closed.end() if closed else len(source)
            elif following in ("!", "?") and at < last_end:
                end = source.index(">", at) + 1
            else:
                at += 1
                continue
            yield at, end, "", False, ""
            at = end
            continue
        if at > last_end:
            return
        end = len(source) if unclosed else _ATTRIBUTES.match(source, found.end()).end()
        if end == len(source):
            # No ">" ends this tag outside of quotes; nor does one end the tags after it.
            unclosed, end = True, source.index(">", found.end())
        name, attributes = found[2].lower(), source[found.end() : end]
        end += 1
        if found[1]:
            yield at, end, name, True, ""
        elif name in _RAW:
            closed = _RAW[name].search(source, end)
            end = closed.end() if closed else len(source)
            yield at, end, "", False, ""
        elif name in _SKIPPED and last_close[name] >= end and not (name == "svg" and attributes.endswith("/")):
            closed = _SKIPPED[name].search(source, end)
            end = closed.end() if closed else end
            yield at, end, "", False, ""
        else:
            yield at, end, name, False, attributes
        at = end


def parse(source: str) -> Page:
    """The tree of block elements and text blocks. Scripts, styles, titles and markup are left out, references are
    decoded, white space in a block becomes one space. Broken markup closes where its container does."""
    page = Page([-1], ["html"], [()], [None], [0], [0])
    open_nodes: list[tuple[str, int]] = [("html", 0)]
    standing: Counter[str] = Counter()
    run: list[str] = []
    state = {"link": 0, "linked": 0, "from": 0}

    def flush() -> None:
        text = " ".join(html.unescape("".join(run)).split()) if run else ""
        if text:
            page.parents.append(open_nodes[-1][1])
            page.kinds.append("text")
            page.hints.append(())
            page.texts.append(text)
            page.linked.append(state["linked"])
            page.offsets.append(state["from"])
        run.clear()
        state["linked"] = 0

    def add(text: str, at: int) -> None:
        if text:
            if not run:
                state["from"] = at + len(text) - len(text.lstrip())
            run.append(text)
            if state["link"]:
                state["linked"] += len(text)

    def close(names: set[str], stop: set[str]) -> None:
        if not any(standing[n] for n in names):
            return
        for i in range(len(open_nodes) - 1, 0, -1):
            if open_nodes[i][0] in names:
                standing.subtract(n for n, _ in open_nodes[i:])
                del open_nodes[i:]
                return
            if open_nodes[i][0] in stop:
                return

    last = 0
    for begin, end, name, is_end, attributes in tags(source):
        add(source[last:begin], last)
        last = end
        if not name:
            continue
        if name == "a":
            state["link"] = 0 if is_end else 1
        elif name == "br":
            run.append(" ")
        if name not in _BLOCKS:
            continue
        flush()
        if is_end:
            close({name}, set())
            continue
        if name == "html":
            continue
        names, stop = _CLOSES.get(name, ({"p"}, {"div", "article", "section", "td", "th", "li", "main", "blockquote", "body"}))
        close(names, stop)
        if name not in _VOID:
            page.parents.append(open_nodes[-1][1])
            page.kinds.append(name)
            page.hints.append(_hints(attributes) if attributes else ())
            page.texts.append(None)
            page.linked.append(0)
            page.offsets.append(begin)
            open_nodes.append((name, len(page.parents) - 1))
            standing[name] += 1
    add(source[last:], last)
    flush()
    return page


@dataclass
class Forest:
    """The nodes of several pages: features, parents (-1 for roots), and the nodes of each depth."""

    features: np.ndarray
    parents: np.ndarray
    levels: list[np.ndarray]


def forest(pages: list[Page]) -> Forest:
    size = sum(len(p.parents) for p in pages)
    x = np.zeros((size, FEATURES))
    parents = np.full(size, -1, np.int64)
    depth = np.zeros(size, np.int64)
    kind_at = {k: 1 + i for i, k in enumerate(_KINDS)}
    own, above = 1 + len(_KINDS), 1 + len(_KINDS) + len(_HINT_NAMES)
    free = above + len(_HINT_NAMES)
    base = 0
    x[:, 0] = 1
    for page in pages:
        for i, (parent, kind, hints, text) in enumerate(zip(page.parents, page.kinds, page.hints, page.texts)):
            at = base + i
            if parent >= 0:
                parents[at] = base + parent
                depth[at] = depth[base + parent] + 1
            x[at, kind_at[_TAG_KINDS.get(kind, "div")]] = 1
            for h in hints:
                x[at, own + h] = 1
            x[at, free + 7] = kind == "header" and page.kinds[parent] in ("body", "html")
            if text is not None:
                for h in page.hints[parent]:
                    x[at, above + h] = 1
                words = text.count(" ") + 1
                x[at, free : free + 7] = (
                    words <= 3, words >= 12, words >= 40, min(1.0, page.linked[i] / len(text)),
                    text[-1] in ".!?:\"", text.count(",") > 0, "©" in text,
                )
        base += len(page.parents)
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(depth.max(initial=-1) + 2))
    return Forest(x, parents, [order[a:b] for a, b in zip(cuts, cuts[1:])])


@dataclass
class Model:
    """Weights of the features for state 1, and the log potentials of (parent's state, child's state)."""

    weights: np.ndarray
    edges: np.ndarray


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)


def marginals(trees: Forest, model: Model) -> tuple[np.ndarray, np.ndarray, float]:
    """Each node's chance of state 1, each node's joint chances with its parent, and the log partition sum."""
    node = np.zeros((len(trees.parents), 2))
    node[:, 1] = trees.features @ model.weights
    up = np.zeros_like(node)
    belief = node.copy()
    for level in reversed(trees.levels[1:]):
        up[level] = _logsum(model.edges[None] + belief[level][:, None, :], 2)
        np.add.at(belief, trees.parents[level], up[level])
    total = float(_logsum(belief[trees.levels[0]], 1).sum()) if trees.levels else 0.0
    joint = np.zeros((len(node), 2, 2))
    whole = belief.copy()
    for level in trees.levels[1:]:
        rest = whole[trees.parents[level]] - up[level]
        down = rest[:, :, None] + model.edges[None]
        pair = down + belief[level][:, None, :]
        joint[level] = np.exp(pair - pair.max((1, 2), keepdims=True))
        joint[level] /= joint[level].sum((1, 2), keepdims=True)
        whole[level] = belief[level] + _logsum(down, 1)
        whole[level] -= whole[level].max(1, keepdims=True)
    chance = np.exp(whole - whole.max(1, keepdims=True))
    return chance[:, 1] / chance.sum(1) if len(chance) else np.zeros(0), joint, total


def labels_of(page: Page, pieces: list[tuple[str, int]]) -> np.ndarray:
    """Node labels: a text block's from the piece it begins in; an element is content if most of its text is."""
    ends = np.cumsum([len(h) for h, _ in pieces])
    mass = np.zeros((len(page.parents), 2))
    for i, text in enumerate(page.texts):
        if text is not None:
            mass[i, pieces[int(np.searchsorted(ends, page.offsets[i], "right"))][1]] = len(text)
    for i in range(len(page.parents) - 1, 0, -1):
        mass[page.parents[i]] += mass[i]
    return (mass[:, 1] > mass[:, 0]).astype(int)


@lru_cache(maxsize=1)
def trained(pages: int = TRAINING_PAGES, steps: int = 160) -> Model:
    """The model of greatest penalised likelihood on the labelled pages, by gradient steps with running scales."""
    sources = [labelled_page(i) for i in range(pages)]
    parsed = [parse("".join(h for h, _ in s)) for s in sources]
    trees = forest(parsed)
    y = np.concatenate([labels_of(p, s) for p, s in zip(parsed, sources)])
    child = np.flatnonzero(trees.parents >= 0)
    seen_edges = np.zeros((2, 2))
    np.add.at(seen_edges, (y[trees.parents[child]], y[child]), 1)
    seen = trees.features[y == 1].sum(0)
    theta = np.zeros(FEATURES + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        model = Model(theta[:FEATURES], theta[FEATURES:].reshape(2, 2))
        chance, joint, _ = marginals(trees, model)
        slope = np.concatenate([seen - trees.features.T @ chance, (seen_edges - joint.sum(0)).ravel()]) / pages
        slope -= 2e-3 * theta
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        theta = theta + 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(theta[:FEATURES], theta[FEATURES:].reshape(2, 2))


def main_texts(sources: list[str], model: Model) -> list[tuple[str, int, int]]:
    """(text, blocks kept, blocks) of each page: its content blocks in page order, an empty line between them."""
    pages = [parse(s) for s in sources]
    chance, _, _ = marginals(forest(pages), model)
    out, base = [], 0
    for page in pages:
        blocks = [i for i, t in enumerate(page.texts) if t is not None]
        kept = [page.texts[i] for i in blocks if chance[base + i] >= 0.5]
        out.append(("\n\n".join(kept), len(kept), len(blocks)))
        base += len(page.parents)
    return out


def extract(pages: DataFrame, model: Model | None = None, source: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(the columns ``keep``, text, n_chars, kept_blocks, blocks) for each row of ``pages``.

    Null and empty pages, and pages without content, have an empty text; rows with equal or null ids are read one by
    one; other columns are not read. ``model`` defaults to the one trained on the labelled pages.
    """
    model = model or trained()
    named = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]

    def rows(part):
        found = main_texts([r["html"].decode("utf-8", "replace") for r in part], model)
        for row, (text, kept, blocks) in zip(part, found):
            del row["html"]
            yield row | {"text": text, "n_chars": len(text), "kept_blocks": kept, "blocks": blocks}

    held = pages.select(*named, text_bytes(source).alias("html"))
    kinds = ", ".join(f"{n} {t}" for n, t in held.dtypes if n != "html")
    out = map_rows(held, rows, f"{kinds}, text string, n_chars long, kept_blocks int, blocks int")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text", "n_chars", "kept_blocks", "blocks")
