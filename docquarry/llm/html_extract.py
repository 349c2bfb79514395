"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: stretches of text without a block-level tag inside, each
with its open ancestors. Ancestor tags, their class, id and role words, and features of
the text feed a two-label chain (main text or not), trained on labelled pages and decoded
by Viterbi. The labelled pages come from `labelled_pages`, a seeded generator of page
layouts whose blocks carry their labels.

Defined cases: null or empty html gives an empty text. Scripts, styles, comments, titles
and hidden templates are no blocks. Unclosed and stray tags are tolerated; a page that
breaks off inside a tag, script or comment loses only that piece. A link left open ends
with the block that holds it. A very long page is read whole, in memory in proportion to
its length; a page without a block that looks like main text gives an empty text. Character
references are decoded; white space (Unicode) inside a block becomes one space. Repeated rows are
handled alike; extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import map_batches

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|title|textarea|iframe|svg)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open element of the same group.
_CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


@dataclass
class Block:
    text: str
    path: tuple  # open elements from the root: (tag, class/id/role words)
    linked: int  # characters inside links


def leaf_blocks(html: str | None) -> list[Block]:
    blocks: list[Block] = []
    if not html:
        return blocks
    stack: list[tuple] = []
    parts: list[str] = []
    linked, in_link, at = 0, 0, 0  # in_link: the open elements around an open link, and 1

    def add(piece: str):
        nonlocal linked
        if "&" in piece:
            piece = html_lib.unescape(piece)
        parts.append(piece)
        if in_link:
            linked += len(piece)

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append(Block(text, tuple(e for e in stack if e[0] not in _INLINE), linked))
            parts.clear()
        linked = 0

    def close(k: int):
        """Close the open elements from the k-th on, and a link that one of them holds."""
        nonlocal in_link
        del stack[k:]
        if in_link > k + 1:
            in_link = 0

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                in_link = 0 if m.group(2) else len(stack) + 1
            continue
        flush()
        if m.group(2):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        closes = _CLOSES.get(tag) or ({"p"} if tag in _CLOSES_P else ())
        while stack and stack[-1][0] in closes:
            close(len(stack) - 1)
        if tag in _VOID or m.group(4).endswith("/"):
            continue
        words: tuple = ()
        if m.group(4):
            words = tuple(_WORDS.findall(" ".join(a or b or c for a, b, c in _MARKS.findall(m.group(4))).lower()))
        stack.append((tag, words))
    add(html[at:])
    flush()
    return blocks


# -- features and model --------------------------------------------------------------


def path_features(path: tuple) -> list[str]:
    out = {f"in:{tag}" for tag, _ in path} | {f"word:{w}" for _, words in path for w in words}
    return sorted(out | {f"leaf:{path[-1][0] if path else 'none'}"})


def text_features(block: Block) -> list[str]:
    n = len(block.text)
    out = ["bias", f"long:{min(6, n.bit_length() - 3) if n > 7 else 0}"]
    if block.linked * 2 > n:
        out.append("links")
    if block.text[-1] in ".!?…\"”":
        out.append("sentence")
    if "©" in block.text or "copyright" in block.text.lower():
        out.append("rights")
    if "|" in block.text or "·" in block.text or "»" in block.text:
        out.append("bars")
    return out


@dataclass
class Chain:
    """weights: feature -> (score of other text, score of main text); turn[a][b]: score
    of label b behind label a."""

    weights: dict[str, tuple[float, float]]
    turn: list[list[float]]


class Tagger:
    def __init__(self, chain: Chain):
        self.chain = chain
        self.paths: dict[tuple, tuple[float, float]] = {}

    def _sum(self, features: list[str]) -> tuple[float, float]:
        found = [w for f in features if (w := self.chain.weights.get(f))]
        return sum(w[0] for w in found), sum(w[1] for w in found)

    def labels(self, blocks: list[Block]) -> list[int]:
        """Viterbi: 1 for main text."""
        if len(self.paths) > 50_000:
            self.paths.clear()
        (aa, ab), (ba, bb) = self.chain.turn
        back: list[tuple[int, int]] = []
        x = y = 0.0
        for k, block in enumerate(blocks):
            own = self.paths.get(block.path)
            if own is None:
                own = self.paths[block.path] = self._sum(path_features(block.path))
            more = self._sum(text_features(block))
            u, v = own[0] + more[0], own[1] + more[1]
            if not k:
                x, y = u, v
                continue
            back.append((0 if x + aa >= y + ba else 1, 0 if x + ab >= y + bb else 1))
            x, y = max(x + aa, y + ba) + u, max(x + ab, y + bb) + v
        label = int(y > x)
        out = [label] if blocks else []
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def main_text(self, html: str | None) -> str:
        blocks = leaf_blocks(html)
        return "\n".join(b.text for b, label in zip(blocks, self.labels(blocks), strict=True) if label)


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 150, decay: float = 0.02) -> Chain:
    """Maximum likelihood with an L2 penalty, by adaptive gradient steps; the gradient is
    observed minus expected feature counts, the latter by forward-backward sums over all
    pages at once."""
    pages = [p for p in pages if p[0]]
    names = sorted({f for blocks, _ in pages for b in blocks for f in path_features(b.path) + text_features(b)})
    index = {f: i for i, f in enumerate(names)}
    longest = max(len(b) for b, _ in pages)
    n, k = len(pages), len(names)
    real = np.zeros((n, longest), bool)
    gold = np.zeros((n, longest), int)
    page_at, feature_at = [], []
    for p, (blocks, labels) in enumerate(pages):
        real[p, : len(blocks)], gold[p, : len(blocks)] = True, labels
        for t, block in enumerate(blocks):
            found = [index[f] for f in path_features(block.path) + text_features(block)]
            page_at += [p * longest + t] * len(found)
            feature_at += found
    page_at, feature_at = np.array(page_at), np.array(feature_at)
    hit = np.eye(2)[gold] * real[..., None]
    pair = real[:, 1:, None, None] * np.einsum("pta,ptb->ptab", np.eye(2)[gold[:, :-1]], np.eye(2)[gold[:, 1:]])
    weights, turn = np.zeros((k, 2)), np.zeros((2, 2))
    power_w, power_t = np.full((k, 2), 1e-8), np.full((2, 2), 1e-8)

    def lse(a, axis):
        top = a.max(axis, keepdims=True)
        return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)

    for _ in range(rounds):
        score = np.zeros((n * longest, 2))
        np.add.at(score, page_at, weights[feature_at])
        score = score.reshape(n, longest, 2)
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = score[:, 0]
        for t in range(1, longest):
            step = lse(ahead[:, t - 1, :, None] + turn, 1) + score[:, t]
            ahead[:, t] = np.where(real[:, t, None], step, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = lse(turn + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(real[:, t + 1, None], step, 0.0)
        total = lse(ahead[:, -1], 1)
        each = np.exp(ahead + behind - total[:, None, None]) * real[..., None]
        both = np.exp(ahead[:, :-1, :, None] + turn + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]) * real[:, 1:, None, None]
        slope = np.zeros((k, 2))
        np.add.at(slope, feature_at, (hit - each).reshape(-1, 2)[page_at])
        slope -= decay * n * weights / 10
        turn_slope = (pair - both).sum((0, 1)) - decay * n * turn / 10
        power_w += slope**2
        power_t += turn_slope**2
        weights += 0.5 * slope / np.sqrt(power_w)
        turn += 0.5 * turn_slope / np.sqrt(power_t)
    return Chain({f: (float(weights[i, 0]), float(weights[i, 1])) for f, i in index.items()}, turn.tolist())


# -- labelled pages --------------------------------------------------------------------


def _sentence(rng: random.Random, low: int, high: int) -> str:
    return " ".join("".join(rng.choice("aeiounrstlmdk") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(low, high))).capitalize() + "."


def labelled_page(seed: int) -> tuple[str, list[str]]:
    """A made-up page and its main-text blocks in order."""
    rng = random.Random(seed)
    main: list[str] = []

    def keep(tag: str, text: str, close: bool = True) -> str:
        main.append(text)
        return f"<{tag}>{text}" + (f"</{tag}>" if close else "")

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{_sentence(rng, 1, 3)}</a></li>' for i in range(n)) + "</ul>"

    def neutral(inner: str, chance: float) -> str:
        """Inside elements that say nothing, any number of them."""
        while rng.random() < chance:
            mark = rng.choice(["", "", ' class="wrap"', ' class="row"', ' id="page"', ' class="container"', ' class="col"', ' class="text"', ' class="inner"'])
            tag = rng.choice(["div", "div", "div", "section"])
            inner = f"<{tag}{mark}>{inner}</{tag}>"
        return inner

    def box(names: list[str], inner: str, tags: tuple = ("div", "section", "aside")) -> str:
        tag = rng.choice(tags)
        return f'<{tag} {rng.choice(["class", "class", "id"])}="{rng.choice(names)}">{inner}</{tag}>'

    def prose(n: int, low: int = 6, high: int = 40) -> str:
        return "".join(f"<p>{_sentence(rng, low, high)}</p>" for _ in range(n))

    ad = ["ad", "ads", "advert", "banner ad", "sponsored", "promo"]
    notice = ["cookie", "cookie-notice", "notice", "consent", "alert", "newsletter"]
    before = []
    if rng.random() < 0.8:
        before.append(f"<nav>{links(rng.randint(3, 9))}</nav>" if rng.random() < 0.7 else box(["menu", "nav", "navigation", "breadcrumb"], links(rng.randint(2, 8))))
    if rng.random() < 0.5:
        before.append(f"<header><h1>{_sentence(rng, 1, 3)}</h1><p>{_sentence(rng, 3, 8)}</p></header>" if rng.random() < 0.6 else box(["header", "masthead", "site-header"], f"<p>{_sentence(rng, 2, 8)}</p>", ("div",)))
    if rng.random() < 0.6:
        before.append(box(ad, rng.choice(["", "<p>"]) + _sentence(rng, 3, 14), ("div",)))
    if rng.random() < 0.4:
        before.append(box(notice, prose(1, 5, 25)))
    if rng.random() < 0.3:
        before.append(f"<form><label>{_sentence(rng, 1, 3)}</label><input name=q><p>{_sentence(rng, 2, 6)}</p><button>{_sentence(rng, 1, 2)}</button></form>")
    rng.shuffle(before)
    before = [neutral(part, 0.2) for part in before]

    body = []
    old = rng.random() < 0.12  # paragraphs in plain divs
    if rng.random() < 0.85:
        body.append(keep("h1", _sentence(rng, 2, 10)))
    for _ in range(rng.randint(1, 12)):
        kind = rng.random()
        if kind < 0.58 and old:
            body.append(keep("div", _sentence(rng, 8, 70)))
        elif kind < 0.58:
            body.append(neutral(keep("p", _sentence(rng, 1, 70), rng.random() < 0.8), 0.08))
        elif kind < 0.68:
            body.append(keep(rng.choice(["h2", "h3"]), _sentence(rng, 2, 7)))
        elif kind < 0.76:
            body.append("<ul>" + "".join(keep("li", _sentence(rng, 3, 15)) for _ in range(rng.randint(2, 5))) + "</ul>")
        elif kind < 0.82:
            body.append(f"<blockquote>{keep('p', _sentence(rng, 5, 30))}</blockquote>")
        elif kind < 0.86:
            body.append("<table><tr>" + "".join(keep("td", _sentence(rng, 1, 4)) for _ in range(3)) + "</tr></table>")
        elif kind < 0.94:
            body.append(box(ad, f"<p>{_sentence(rng, 3, 12)}</p>", ("div", "aside")))
        else:
            body.append(box(["share", "related", "social"], links(3), ("div", "aside")))
    inner = "".join(body)
    holder = rng.random()
    if holder < 0.5:
        content = f"<article>{inner}</article>"
    elif holder < 0.65:
        content = f"<main>{inner}</main>"
    elif holder < 0.8:
        content = f'<div {rng.choice(["class", "id"])}="{rng.choice(["content", "post", "entry", "article-body", "main", "story"])}">{inner}</div>'
    elif holder < 0.9:
        content = f"<main><article>{inner}</article></main>"
    else:
        content = inner

    content = neutral(content, 0.4)

    after = []
    if rng.random() < 0.35:
        notes = "".join(f'<div class="comment"><p>{_sentence(rng, 4, 30)}</p></div>' for _ in range(rng.randint(1, 5)))
        after.append(box(["comments", "discussion", "comment-list"], f"<h2>{_sentence(rng, 1, 2)}</h2>{notes}", ("div", "section")))
    if rng.random() < 0.4:
        after.append(f"<aside>{prose(rng.randint(1, 2), 3, 20)}{links(3)}</aside>" if rng.random() < 0.5 else box(["sidebar", "widget", "related"], f"<h3>{_sentence(rng, 1, 3)}</h3>{links(4)}{prose(1, 3, 15)}"))
    if rng.random() < 0.3:
        after.append(box(notice + ad, prose(1, 4, 20)))
    if rng.random() < 0.85:
        note = rng.choice(["&copy; ", "Copyright ", ""]) + _sentence(rng, 2, 15)
        after.append(f"<footer>{note}</footer>" if rng.random() < 0.6 else f"<footer><p>{note}</p>{links(3)}</footer>" if rng.random() < 0.5 else box(["footer", "site-footer", "legal"], f"<p>{note}</p>", ("div",)))
    after = [neutral(part, 0.2) for part in after]
    page = neutral("".join(before) + content + "".join(after), 0.3)
    return f"<html><head><title>x</title></head><body>{page}</body></html>", main


def labelled_pages(n: int = 900) -> list[tuple[list[Block], list[int]]]:
    out = []
    for seed in range(n):
        html, main = labelled_page(seed)
        blocks, left = leaf_blocks(html), list(main)
        labels = []
        for block in blocks:
            mine = bool(left) and block.text == left[0]
            labels.append(int(mine))
            if mine:
                left.pop(0)
        out.append((blocks, labels))
    return out


@lru_cache(1)
def default_chain() -> Chain:
    return train(labelled_pages())


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(chain or default_chain())  # of fixed size

    def run(batches):
        tagger = Tagger(shared.value)
        for batch in batches:
            texts = [tagger.main_text(h) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": list(map(len, texts))})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return map_batches(rows, run, "page_id long, url string, text string, n_chars long", ("page_id",))
