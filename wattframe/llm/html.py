"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>",
    re.S,
)
LABEL = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
WORDS = re.compile(r"[a-z]+|\d+")
PUNCTUATION = re.compile(r"[.,;:!?…。、！？]")

# Fixed values of the HTML standard: elements without content, raw text, blocks, implied ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option "
    "p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the first kind ends an open element of the second, unless one of the third lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr"}, {"table"}), "tfoot": ({"thead", "tbody", "tr"}, {"table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}

# Elements, and words in class, id or role, that mark what is not main text.
APART = frozenset("nav footer aside form script style head button select dialog menu search input label object canvas audio video".split())
APART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation "
    "navigations menu menus breadcrumb breadcrumbs footer foot sidebar sidebars aside widget widgets cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended comment comments commentlist disqus respond reply replies reviews pager pagination toolbar masthead "
    "complementary contentinfo search form copyright legal disclaimer skip hidden tags".split()
)
#: Parts of class names beside such a word that leave its meaning: "cookie-notice", "site-footer", "ad1".
KIND_WORDS = frozenset("site page main top bottom left right box bar block container wrapper wrap section area list inner outer primary secondary global".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Names that set a part apart inside the content too, whatever its text is like.
ALWAYS_WORDS = frozenset("comments commentlist disqus respond replies navbar sidebar sidebars breadcrumb breadcrumbs pager pagination advertisement contentinfo complementary".split())
#: Other names do so inside the content only if that share of the text is linked, or its ratio is below that share of the content's.
LINKED, LOW = 0.5, 0.5
#: "no-sidebar" says nothing of what it names.
DENIED = frozenset("no without with has have".split())
#: Elements that can hold a whole text, and the share of the content that the text's container holds at least.
SECTIONS = frozenset(["", *"article body center dd div fieldset html li main section td".split()])
SHARE = 0.95
#: Share of the content from which <article> or <main> elements are the text.
NAMED = {"article": 0.9, "main": 0.6}
TOPS = frozenset("html body article main".split())
#: A page's own header is apart; the heading of an article is not.
INSIDE = frozenset("article main".split())
INSIDE_WORDS = frozenset("article main content post entry story body text".split())


class Block(NamedTuple):
    path: str
    owners: tuple[tuple[int, str], ...]
    text: str
    linked: int
    apart: bool
    marked: int = 0  # the element inside the content whose name speaks against it


class _Open:
    __slots__ = ("name", "number", "path", "apart", "inside", "marked")

    def __init__(self, name, number, path, apart, inside, marked=0):
        self.name, self.number, self.path, self.apart, self.inside, self.marked = name, number, path, apart, inside, marked


def apart_names(names: list[str]) -> set[str]:
    """Of class, id and role names those that mark a part: a word of APART_WORDS, alone or with words of the same kind ("site-footer")."""
    found = set()
    for name in names:
        words = WORDS.findall(name)
        if words and words[0] not in DENIED and any(w in APART_WORDS for w in words):
            if all(w in APART_WORDS or w in KIND_WORDS or w.isdigit() for w in words):
                found |= {name, *(words if len(words) == 1 else ())}
    return found


def blocks_of(page: str) -> list[Block]:
    """The page's text by block, in page order, with the tag path of each and the elements around it."""
    found: list[Block] = []
    stack = [_Open("", 0, "", False, False)]
    parts: list[str] = []
    linked = number = at = 0
    links = 0

    def flush():
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            top = next((e for e in reversed(stack) if e.name in BLOCKS or not e.name), stack[0])
            found.append(Block(top.path or "/", tuple((e.number, e.name) for e in stack if e.name in BLOCKS or not e.name), text, linked, stack[-1].apart, stack[-1].marked))
        parts.clear()
        linked = 0

    def pop(to: int):
        nonlocal links
        if any(e.name in BLOCKS for e in stack[to:]):
            flush()
        links -= sum(e.name == "a" for e in stack[to:])
        del stack[to:]

    size = len(page)
    while at < size:
        match = TOKEN.search(page, at)
        text = page[at : match.start() if match else size]
        if text:
            parts.append(text)
            linked += len(text.strip()) if links else 0
        if not match:
            break
        at = match.end()
        name = (match["name"] or match["name2"] or "").lower()
        if not name:
            continue
        attrs = match["attrs"] if match["name"] else match["attrs2"]
        if match["close"] or match["close2"]:
            if name == "br":
                parts.append(" ")
            elif name == "p" and not any(e.name == "p" for e in stack):
                flush()
            else:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].name == name:
                        pop(depth)
                        break
                    if stack[depth].name in BLOCKS and name not in BLOCKS:
                        break
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if not attrs.rstrip().endswith("/") or name not in ("svg", "math"):
                at = end.end() if end else size
            if name in ("noscript", "iframe", "textarea"):
                parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == "p":
                    pop(depth)
                    break
                if stack[depth].name in ("td", "th", "table", "button", "object", "li", "div", "article", "section"):
                    break
        if name in ENDS:
            ends, stops = ENDS[name]
            cut = 0
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name in stops:
                    break
                if stack[depth].name in ends:
                    cut = depth
            if cut:
                pop(cut)
        if name in VOID:
            continue
        number += 1
        above = stack[-1]
        pairs = [(m[0].lower(), " ".join(m[1:]).lower()) for m in LABEL.findall(attrs)] if attrs else []
        labels = WORDS.findall(" ".join(v for _, v in pairs))
        marks = apart_names([n for k, v in pairs if k != "id" or name not in HEADINGS for n in v.split()])
        words = {w for w, before in zip(labels, ["", *labels]) if before not in DENIED}
        inside = above.inside or name in INSIDE or (name in ("div", "section", "td") and bool(words & INSIDE_WORDS) and not marks)
        apart = (
            above.apart or name in APART or (name == "header" and not above.inside)
            or (bool(marks) and name not in TOPS and (not above.inside or bool(marks & ALWAYS_WORDS)))
            or (bool(attrs) and HIDDEN.search(attrs) is not None)
        )
        step = name if name not in ("div", "section", "span", "td") or not labels else f"{name}.{labels[0]}"
        marked = above.marked or (number if marks and name in BLOCKS and name not in TOPS else 0)
        stack.append(_Open(name, number, f"{above.path}/{step}" if name in BLOCKS else above.path, apart, inside, marked))
        links += name == "a"
    flush()
    return found


def path_ratios(blocks: list[Block]) -> list[float]:
    """For each block the fused ratio of its tag path.

    A path's ratio is its characters a node, less those in links, times its punctuation marks a node, on
    a logarithmic scale.  The series of the blocks' ratios is smoothed with a Gaussian window in page
    order, and fused with the path's own ratio by their geometric mean.  What stands in parts that
    are no main text by their markup counts as 0.
    """
    sums: dict[str, list[float]] = defaultdict(lambda: [0, 0, 0])
    for b in blocks:
        if not b.apart:
            total = sums[b.path]
            total[0] += 1
            total[1] += max(0, len(b.text) - 2 * b.linked)
            total[2] += len(PUNCTUATION.findall(b.text))
    own = {p: math.log1p(c / k) * math.log1p(1 + m / k) for p, (k, c, m) in sums.items()}
    series = [0.0 if b.apart else own[b.path] for b in blocks]
    kernel = [math.exp(-d * d / 2) for d in range(3)]
    fused = []
    for i, value in enumerate(series):
        near = [(kernel[abs(j - i)], series[j]) for j in range(max(0, i - 2), min(len(series), i + 3))]
        smooth = sum(w * v for w, v in near) / sum(w for w, _ in near)
        fused.append(math.sqrt(value * smooth))
    return fused


def without_marked(blocks: list[Block]) -> list[Block]:
    """The blocks, with marked parts inside the content set apart that are mostly links or unlike the content's text."""
    parts: dict[int, list[int]] = defaultdict(list)
    for i, b in enumerate(blocks):
        if b.marked and not b.apart:
            parts[b.marked].append(i)
    if not parts:
        return blocks
    ratios = path_ratios(blocks)
    size = lambda own: sum(len(blocks[i].text) for i in own)
    mean = lambda own: sum(ratios[i] * len(blocks[i].text) for i in own) / max(1, size(own))
    plain = mean([i for i, b in enumerate(blocks) if not b.apart and not b.marked])
    found = list(blocks)
    for own in parts.values():
        if sum(blocks[i].linked for i in own) >= LINKED * size(own) or mean(own) < LOW * plain:
            for i in own:
                found[i] = blocks[i]._replace(apart=True)
    return found


def main_text(page: str | None) -> str:
    """The main text of a page: its content blocks, one a line.

    Blocks whose ratio exceeds a threshold, a share of the page's mean and deviation, are content
    nodes.  Where the page's articles, or its main element, hold most of the content, they are the text.  Else it is the
    innermost element that holds nearly all of the content, and content nodes beside it.  All blocks in
    these belong to the text, short ones too, but for those in parts that are no main text by their markup.
    """
    blocks = without_marked(blocks_of(page or ""))
    ratios = path_ratios(blocks)
    positive = [r for r in ratios if r > 0]
    if not positive:
        return ""
    mean = sum(positive) / len(positive)
    deviation = math.sqrt(sum((r - mean) ** 2 for r in positive) / len(positive))
    content = {i for i, r in enumerate(ratios) if r > 0 and r >= mean - deviation}
    weight: dict[int, float] = defaultdict(float)
    for i in content:
        for number, _ in blocks[i].owners:
            weight[number] += len(blocks[i].text) * ratios[i]
    for name, least in NAMED.items():
        inside = [any(n == name for _, n in b.owners) for b in blocks]
        if sum(len(blocks[i].text) * ratios[i] for i in content if inside[i]) >= least * weight[0]:
            return "\n".join(b.text for b, i in zip(blocks, inside) if i and not b.apart)
    # owners are listed from the root down, so the last that holds enough is the innermost
    owners = max((blocks[i] for i in content), key=lambda b: sum(weight[n] for n, _ in b.owners)).owners
    level = [k for k, (n, name) in enumerate(owners) if name in SECTIONS and weight[n] >= SHARE * weight[0]][-1]
    return "\n".join(b.text for i, b in enumerate(blocks) if not b.apart and (i in content or owners[level] in b.owners))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``id``, the ``keep`` columns and ``text`` for every row; a page that is null, empty or without main text has ''.

    A page is read by itself, so there is no shuffle and a page of any size takes memory for itself only.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"), *keep)
    rest = [f for f in rows.schema.fields if f.name != "html"]

    def extract(batches):
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column("html")]
            yield pa.RecordBatch.from_pydict(
                {**{f.name: batch.column(f.name) for f in rest}, "text": pa.array(texts, pa.string())}
            )

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest]
    return rows.mapInArrow(extract, ", ".join([*columns, "text string"]))
