"""Main text of web pages from flat text blocks.

A page is cut into blocks at block-level tags.  A block is described by its words and share of words in links, the same of two
blocks on either side, its sentences and capitals, its tag, its place in the page, and by what it stands in: parts named by tags
(articles, menus), and parts named by a class or id, with the share of the page's words that such a part holds.  None of
these decides alone: a decision tree, grown here from a small labelled table of blocks, says which blocks are main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvane.llm.html_training import training_pages
from corvane.runtime import spread_small

# Tags that part blocks, tags whose content is no text, and words that name parts beside the text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr "
    "html iframe label legend li main menu meta nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
RAW_TAGS = "title|script|style|noscript|template|textarea|svg|math|iframe|object|canvas"
# Of these the slash at the end of the tag does not close the element.
NEVER_EMPTY = "title|script|style|textarea|template"
MAIN_TAGS = frozenset(["article", "main"])
BESIDE_TAGS = frozenset("head nav footer aside button select fieldset dialog menu label option".split())
BESIDE_WORDS = re.compile(
    r"(?i)(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|side-?bar|menu|nav\w*|bread-?crumbs?|foot\w*|masthead|comments?|respond|replies|disqus|cookies?|consent|notice|alert|popup|modal"
    r"|newsletter|subscri\w*|share|sharing|social|related|widget|legal|copyright|login|search)"
)
CONTAINERS = frozenset("article main nav footer aside form header head section div ul ol table dialog menu fieldset button select figure label option".split())
KINDS = {"p": 1, "h1": 2, "h2": 2, "h3": 2, "h4": 2, "h5": 2, "h6": 2, "li": 3, "dt": 3, "dd": 3, "td": 4, "th": 4, "blockquote": 5, "pre": 5, "br": 6}

_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*"|'[^']*')*+"""
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)
    |<({NEVER_EMPTY})(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)
    |<({RAW_TAGS})(?=[\s/>]){_ATTRIBUTES}(?:(?<=/)>|(?<!/)>.*?</\2\s*>)
    |<[!?][^>]*(?:>|\Z)
    |<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_ATTRIBUTES}|[^>]*)(?:>|\Z)""",
    re.S | re.I | re.X,
)
_HINT = re.compile(r"""(?i)\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
_PART = re.compile(r"[-_]+")
_SPACE = re.compile(r"\s+")
_STOP = re.compile(r"[.!?\u2026\u3002](?=\W*(?:\s|\Z))")

FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "words_before_2", "link_density_before_2", "words_after_2", "link_density_after_2",
    "stops", "capitals", "kind", "upto", "articles", "beside_tags", "headers", "forms", "named", "named_share",
)
# How many of a block's own features come before those of its neighbours are added.
_OWN = ("words", "link_density", "stops", "capitals", "kind", "articles", "beside_tags", "headers", "forms", "named")


def named(attributes: str) -> int:
    """2 if a class, id or role is the name of a part beside the text or all its words are, 1 if it has such a word in it, else 0."""
    out = 0
    for m in _HINT.finditer(attributes):
        for token in m[1].strip("\"'").split():
            known = [bool(BESIDE_WORDS.fullmatch(w)) for w in _PART.split(token)]
            if BESIDE_WORDS.fullmatch(token) or all(known):
                return 2
            if any(known):
                out = 1
    return out


def blocks(page: str) -> list[tuple[str, tuple, tuple[int, ...], bool]]:
    """Text, own features, the named parts around it (innermost last) and training mark of every block."""
    out: list[tuple[str, tuple, tuple[int, ...], bool]] = []
    stack: list[tuple[str, int]] = []  # open containers: tag, number of the part if it is a named one
    counts = dict.fromkeys(("articles", "beside", "header", "form"), 0)
    strength: dict[int, int] = {}
    texts: list[str] = []
    linked: list[str] = []
    in_link, marked, kind, own_part, n_parts = False, False, 0, 0, 0

    def kind_of(tag: str) -> str:
        return "articles" if tag in MAIN_TAGS else "beside" if tag in BESIDE_TAGS else tag if tag in ("header", "form") else ""

    def close() -> None:
        if not texts:
            return
        text = "".join(texts)
        text = _SPACE.sub(" ", html.unescape(text) if "&" in text else text).strip()
        if text:
            words = text.split(" ")
            links = len(html.unescape(" ".join(linked)).split()) if linked else 0
            parts = tuple(p for _, p in stack if p) + ((own_part,) if own_part else ())
            capitals = sum(w[0].isupper() for w in words) / len(words)
            own = (len(words), min(1.0, links / len(words)), len(_STOP.findall(text)) / len(words), capitals, kind, min(2, counts["articles"]), min(2, counts["beside"]), min(1, counts["header"]), min(1, counts["form"]))
            out.append((text, (*own, strength[parts[-1]] if parts else 0), parts, marked))
        texts.clear()
        linked.clear()

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at:
            piece = page[at : token.start()]
            texts.append(piece)
            if in_link:
                linked.append(piece)
        at = token.end()
        tag = token[4]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = not token[3]
        if tag not in BLOCK_TAGS:
            continue
        close()
        attributes = token[5]
        kind = KINDS.get(tag, 0) if not token[3] else 0
        own_part = 0
        told = named(attributes) if "=" in attributes and not token[3] and tag not in ("body", "html") else 0
        if told:
            n_parts += 1
            strength[n_parts] = told
        if not token[3]:
            marked = "data-main" in attributes
        if tag not in CONTAINERS:
            own_part = n_parts if told else 0
            continue
        if token[3]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    for gone, _ in stack[k:]:
                        if what := kind_of(gone):
                            counts[what] -= 1
                    del stack[k:]
                    break
            in_link = False
        elif not attributes.endswith("/"):
            stack.append((tag, n_parts if told else 0))
            if what := kind_of(tag):
                counts[what] += 1
    if at < len(page):
        texts.append(page[at:])
    close()
    return out


def features(found: list[tuple[str, tuple, tuple[int, ...], bool]]) -> np.ndarray:
    """(blocks, FEATURES); beyond the ends of a page there are empty blocks."""
    own = np.array([b[1] for b in found], "f8").reshape(-1, len(_OWN))
    total = max(1.0, own[:, 0].sum())
    held: dict[int, float] = {}
    for b in found:
        for p in b[2]:
            held[p] = held.get(p, 0.0) + b[1][0]
    share = np.array([held[b[2][-1]] / total if b[2] else 0.0 for b in found])
    wide = np.zeros((len(own) + 4, 2))
    wide[2:-2] = own[:, :2]
    beside = [wide[2 + d : 2 + d + len(own)] for d in (-1, 1, -2, 2)]
    upto = (np.cumsum(own[:, 0]) - own[:, 0]) / total
    return np.column_stack([own[:, :2], *beside, own[:, 2:5], upto, own[:, 5:], share])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 3) -> tuple:
    """A tree of (feature, bound, at most, above), leaves being the majority label of ``least`` rows or more; splits by Gini impurity."""
    if depth == 0 or len(set(y.tolist())) < 2 or len(y) < 2 * least:
        return (bool(2 * y.sum() >= len(y)),)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(np.diff(v))
        cut = cut[(cut + 1 >= least) & (len(y) - cut - 1 >= least)]
        if len(cut):
            left, total = cut + 1.0, len(y)
            a, b = ones[cut], ones[-1] - ones[cut]
            gini = 2 * (a * (1 - a / left) + b * (1 - b / (total - left)))
            k = int(gini.argmin())
            if best is None or gini[k] < best[0] - 1e-12:
                best = (gini[k], f, (v[cut[k]] + v[cut[k] + 1]) / 2)
    if best is None:
        return (bool(2 * y.sum() >= len(y)),)
    below = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[below], y[below], depth - 1, least), grow(x[~below], y[~below], depth - 1, least)


def decide(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    return np.where(x[:, tree[0]] <= tree[1], decide(tree[2], x), decide(tree[3], x))


@cache
def train() -> tuple:
    """The tree of the labelled pages."""
    return grow(*labelled(training_pages()))


def labelled(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of pages whose main blocks carry ``data-main``."""
    found = [blocks(p) for p in pages]
    return np.concatenate([features(p) for p in found]), np.array([b[3] for p in found for b in p], float)


def main_text(page: str, tree: tuple) -> tuple[str, int, int]:
    """Main text, and how many blocks it has of how many."""
    found = blocks(page)
    if not found:
        return "", 0, 0
    keep = decide(tree, features(found))
    return "\n".join(b[0] for b, k in zip(found, keep.tolist()) if k), int(keep.sum()), len(found)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per page: ``page_id, url, text, n_chars, n_main_blocks, n_blocks``.

    Null and empty pages give an empty text; pages without tags are one block; repeated rows give repeated results.
    """
    tree = train()
    names = ["page_id", "url", "text", "n_chars", "n_main_blocks", "n_blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = [main_text(p or "", tree) for p in part.column(2).to_pylist()]
                texts = [r[0] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
                    names=names,
                )

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return spread_small(rows).mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint, n_main_blocks bigint, n_blocks bigint")
