"""Main text of web pages from flat text blocks.

A page becomes a row of text blocks. Each has its word count, its link density, those of its neighbours, and what the
elements around it are for. A decision tree, trained on the small labelled table below, tells content from the rest.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Elements that break the flow of text, and those whose content is no text.
BLOCKS = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot
th thead tr ul""".split())
RAW = "script|style|head|title|noscript|template|iframe|object|svg|math|textarea|select|button|canvas|audio|video"
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
APART = set("nav header footer aside form menu dialog fieldset".split())
# Words of class and id that name something beside the article.
APART_NAMES = set("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments
consent cookie cookies copyright disqus footer form header hidden login masthead menu modal nav navbar navigation
newsletter notice notices notification outbrain pager pagination popup promo promotion promotions related replies reply
respond share sharing sidebar signup social sponsor sponsored subscribe subscription taboola toolbar widget widgets""".split())

# A name of several words that ends in one of these is a container of the article, whatever else it names.
CONTENT_NAMES = set("article body content main offset text".split())

_HEAD = re.compile(r"<(/?)([a-z][^\s/>]*)", re.I)
_RAW = re.compile(r"(?:" + RAW + r")\Z", re.I)
_STOP = re.compile("[>\"']")
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    apart: bool
    within: bool
    heading: bool


def _names(attributes: str) -> set[str]:
    found = set()
    for _, value in _NAMES.findall(attributes):
        for token in value.strip("\"'").lower().split():
            words = [w for w in re.split(r"[^a-z0-9]+", token) if w]
            if len(words) < 2 or words[-1] not in CONTENT_NAMES:
                found.update(words)
    return found


def _beside(attributes: str) -> bool:
    """Whether class, id, role or a hiding attribute set an element apart from the article."""
    return bool(attributes) and (bool(_HIDDEN.search(attributes)) or not APART_NAMES.isdisjoint(_names(attributes)))


def tags_of(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, is an end tag, attributes) of each piece of markup; comments, declarations and elements that hold
    no text have no name and reach to their own end. One pass: what is known not to follow is not looked for again."""
    dead: set[int] = set()  # places outside of quotes from which no end of a tag is found

    def tag_end(at: int) -> int:
        seen = []
        while at not in dead:
            seen.append(at)
            stop = _STOP.search(page, at)
            if stop is None:
                break
            if stop[0] == ">":
                return stop.end()
            closing = page.find(stop[0], stop.end())
            if closing < 0:
                break
            at = closing + 1
        dead.update(seen)
        return -1

    at, last = page.find("<"), page.rfind(">")
    while at >= 0:
        end, name, ends, attributes = -1, "", False, ""
        if page.startswith("<!--", at):
            closing = page.find("-->", at + 4)
            end = len(page) if closing < 0 else closing + 3
        elif at > last:
            at = page.find("<!--", at + 1)
            continue
        elif head := _HEAD.match(page, at):
            end = tag_end(head.end())
            if end < 0:
                end = page.find(">", head.end()) + 1 or -1
            elif not head[1] and _RAW.match(head[2]):
                closing = re.compile(rf"</{head[2]}\s*>", re.I).search(page, end)
                end = closing.end() if closing else len(page)
            else:
                name, ends, attributes = head[2].lower(), bool(head[1]), page[head.end():end - 1]
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at) + 1 or -1
        if end > 0:
            yield at, end, name, ends, attributes
        at = page.find("<", max(end, at + 1))


def blocks_of(page: str | None) -> list[Block]:
    """The text blocks of a page in order; markup that never ends reaches to the end of the page."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # element, apart, within the article
    parts: list[tuple[str, bool]] = []
    opened: Counter[str] = Counter()
    links = heading = 0
    beside = False  # the paragraph or heading itself is set apart

    def close() -> None:
        nonlocal parts, beside
        text = " ".join("".join(p for p, _ in parts).split())
        if text:
            linked = sum(len(p.split()) for p, in_link in parts if in_link)
            words = len(text.split(" "))
            apart, within = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            out.append(Block(text, words, min(words, linked), apart or beside, within, heading > 0))
        parts, beside = [], False

    at = 0
    for start, stop, name, ends, attributes in tags_of(page):
        if start > at:
            parts.append((entities.unescape(page[at:start]), links > 0))
        at = stop
        if not name:
            continue
        if name == "a":
            links = 0 if ends else 1
            continue
        if name == "br":
            parts.append((" ", links > 0))
        if name not in BLOCKS:
            continue
        close()
        if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            heading = 0 if ends else 1
            beside = not ends and _beside(attributes)
            continue
        if name == "p" or name in VOID:
            heading = 0
            beside = name == "p" and not ends and _beside(attributes)
            continue
        if ends:
            while opened[name]:
                opened[closed := stack.pop()[0]] -= 1
                if closed == name:
                    break
            links = 0
        else:
            apart, within = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            if name in ("article", "main"):
                apart, within = apart and within, True
            elif name not in ("html", "body"):
                apart = apart or name in APART or _beside(attributes)
            stack.append((name, apart, within))
            opened[name] += 1
    if at < len(page):
        parts.append((entities.unescape(page[at:]), links > 0))
    close()
    return out


def features(blocks: list[Block]) -> list[list[float]]:
    """For each block: words, link density, both for the block before and after, whether it is apart, within the
    article, a heading, and whether any block of the page is within an article."""
    anywhere = float(any(b.within and not b.apart for b in blocks))
    density = [b.link_words / b.words for b in blocks]
    out = []
    for k, b in enumerate(blocks):
        before, after = blocks[k - 1] if k else None, blocks[k + 1] if k + 1 < len(blocks) else None
        out.append([b.words, density[k], before.words if before else 0, density[k - 1] if before else 0.0,
                    after.words if after else 0, density[k + 1] if after else 0.0,
                    float(b.apart), float(b.within), float(b.heading), anywhere])
    return out


# words, link density, before (words, density), after (words, density), apart, within, heading, article on the page, content
LABELLED = [
    (80, 0.0, 12, 0.0, 60, 0.0, 0, 1, 0, 1, 1), (2, 0.0, 60, 0.0, 45, 0.0, 0, 1, 0, 1, 1), (1, 0.0, 80, 0.0, 4, 1.0, 0, 1, 0, 1, 1),
    (14, 0.0, 5, 0.0, 90, 0.0, 0, 1, 1, 1, 1), (6, 0.0, 9, 0.0, 120, 0.0, 0, 1, 1, 1, 1), (30, 0.3, 40, 0.0, 50, 0.1, 0, 1, 0, 1, 1),
    (5, 1.0, 70, 0.0, 66, 0.0, 0, 1, 0, 1, 1), (220, 0.05, 0, 0.0, 3, 1.0, 0, 1, 0, 1, 1), (1, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1, 1),
    (9, 0.0, 1, 0.0, 8, 0.0, 0, 1, 0, 1, 1), (40, 0.9, 55, 0.2, 5, 0.0, 0, 1, 0, 1, 1), (17, 0.5, 3, 0.0, 2, 0.0, 0, 1, 0, 1, 1),
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0, 1, 0), (3, 1.0, 2, 1.0, 3, 1.0, 1, 0, 0, 1, 0), (8, 0.0, 1, 1.0, 14, 0.0, 1, 0, 0, 1, 0),
    (35, 0.0, 1, 1.0, 14, 0.0, 1, 0, 0, 1, 0), (90, 0.0, 70, 0.0, 40, 0.0, 1, 1, 0, 1, 0), (12, 0.2, 60, 0.0, 0, 0.0, 1, 0, 0, 1, 0),
    (50, 0.0, 1, 1.0, 9, 0.0, 1, 0, 0, 0, 0), (4, 0.5, 20, 0.0, 90, 0.0, 1, 1, 0, 1, 0), (7, 0.0, 80, 0.0, 30, 0.0, 1, 1, 1, 1, 0),
    (25, 0.1, 12, 0.0, 60, 0.0, 1, 1, 0, 1, 0), (130, 0.0, 8, 0.0, 0, 0.0, 1, 0, 0, 1, 0), (2, 0.0, 0, 0.0, 9, 0.0, 1, 0, 1, 0, 0),
    (6, 0.0, 1, 1.0, 70, 0.0, 0, 0, 0, 1, 0), (30, 0.0, 1, 1.0, 12, 0.0, 0, 0, 0, 1, 0), (15, 0.0, 70, 0.0, 0, 0.0, 0, 0, 0, 1, 0),
    (60, 0.0, 40, 0.0, 0, 0.0, 0, 0, 0, 1, 0), (9, 0.0, 2, 1.0, 80, 0.0, 0, 0, 1, 1, 0), (3, 1.0, 90, 0.0, 3, 1.0, 0, 0, 0, 1, 0),
    (70, 0.0, 8, 0.0, 65, 0.0, 0, 0, 0, 0, 1), (45, 0.1, 50, 0.0, 3, 1.0, 0, 0, 0, 0, 1), (25, 0.0, 60, 0.0, 40, 0.0, 0, 0, 0, 0, 1),
    (18, 0.2, 1, 1.0, 60, 0.0, 0, 0, 0, 0, 1), (8, 0.0, 1, 1.0, 80, 0.0, 0, 0, 1, 0, 1), (5, 0.0, 70, 0.0, 55, 0.0, 0, 0, 1, 0, 1),
    (4, 0.0, 60, 0.0, 52, 0.0, 0, 0, 0, 0, 1), (2, 0.0, 33, 0.0, 48, 0.0, 0, 0, 0, 0, 1), (150, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (3, 1.0, 2, 1.0, 4, 1.0, 0, 0, 0, 0, 0), (2, 1.0, 0, 0.0, 3, 1.0, 0, 0, 0, 0, 0), (12, 0.8, 3, 1.0, 60, 0.0, 0, 0, 0, 0, 0),
    (40, 0.9, 5, 1.0, 4, 1.0, 0, 0, 0, 0, 0), (6, 1.0, 70, 0.0, 80, 0.0, 0, 0, 0, 0, 0), (9, 0.6, 60, 0.0, 5, 1.0, 0, 0, 0, 0, 0),
    (5, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0, 0), (4, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (3, 0.0, 4, 1.0, 3, 0.0, 0, 0, 0, 0, 0),
]


def grow(rows: list[tuple], depth: int = 6):
    """A decision tree: (feature, limit, tree up to the limit, tree above) or the share of content at a leaf."""
    share = sum(r[-1] for r in rows) / len(rows)
    if depth == 0 or share in (0, 1):
        return share
    gini = lambda part: len(part) * (s := sum(r[-1] for r in part) / len(part)) * (1 - s)
    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:]):
            low, high = [r for r in rows if r[f] <= a], [r for r in rows if r[f] > a]
            cost = gini(low) + gini(high)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, (a + b) / 2, low, high)
    if best is None:
        return share
    return best[1], best[2], grow(best[3], depth - 1), grow(best[4], depth - 1)


def judge(tree, row: list[float]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str | None, tree) -> str:
    blocks = blocks_of(page)
    return "\n".join(b.text for b, row in zip(blocks, features(blocks)) if judge(tree, row) >= 0.5)


def extract(pages: DataFrame, labelled: list[tuple] | None = None) -> DataFrame:
    """Per page `page_id`, `url`, `text` (blocks of content in page order, one line each; empty if none) and `n_chars`.

    White space within a block becomes one space. Null or empty html gives an empty text. Repeated rows each give a row;
    other columns are ignored. `labelled` replaces the built-in table.
    """
    tree = grow(labelled or LABELLED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, tree) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), *[F.col(c).cast("string").alias(c) for c in ("url", "html")])
    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")
