"""Main text of web pages by tag-path ratios.

Every run of text is a node with a path of block elements from the root. Text
length and punctuation are summed per path and divided by its nodes; the ratios
are smoothed over neighbouring nodes, fused by multiplication, and weigh the
text of each path. The content element is the innermost one that holds nearly
all of that weight, or the article or main element around that one. Within it a
path is content if its fused ratio reaches a threshold, which elements and names
shift: it is zero in an article or main element, and for paragraphs, headings,
lists, quotes and table cells elsewhere; there, what consists of links is left out, headings excepted.
Elements that name themselves as menus, adverts, forms, reader comments and the like are no
candidates: one such word in any of its names is enough for a container, all names
must hold one for a paragraph or another element of text.

Defined cases: null, empty and text-free pages give the empty string; unclosed
and stray tags, unfinished comments and bare ``<`` are read as browsers do, as
far as text is concerned; a null page_id or url stays null; repeated rows are
read again; an empty table gives no rows; other columns are ignored. Reading is
linear in the length of a page, also of one that never closes a tag; elements
nested more than ``DEPTH`` deep share the path of the last one within it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.texts import blocks

#: Fixed values of HTML: elements by how they hold text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript template iframe svg object select annotation annotation-xml".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var math semantics mi mn mo mrow ms mtext msup msub msubsup mfrac msqrt mroot mover munder munderover mfenced mpadded mphantom mstyle".split())
ENDS_PARAGRAPH = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Words of the choice, each by its role.
NOISE_TAGS = set("nav footer aside form button menu dialog fieldset".split())
NOISE_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
NOISE_NAMES = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer form header login masthead menu "
    "modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related replies reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
CONTENT_NAMES = set("article articlebody body content entry main post story text".split())
#: Words that say how a page is laid out rather than what an element is.
STATES = set("has with without no not is show hide open closed enabled disabled on off allowed".split())
WRAPS = set("wrap wrapper container layout inner grid".split())
LAYOUT_NAMES = set("sidebar header footer nav menu banner".split())
CONTENT_TAGS = set("article main".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
ALWAYS = set("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption".split())
#: Elements nested deeper take the place of the innermost one.
DEPTH = 512
ROOTS = set("html body main".split())

_OPEN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAMED = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)")
_ATTRIBUTES = re.compile(r"((?:[^'\"<>]|\"[^\"<]*\"|'[^'<]*')*+)>")
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Node:
    """A run of text between block borders."""

    path: tuple[str, ...]
    tag: str
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw else {}


def _noise_name(name: str) -> bool:
    """Whether one class or id names something else than content: any word of it does, unless it tells a state of the page or a frame around content."""
    words = {w.lower() for w in _NAME.findall(name)}
    found = words & NOISE_NAMES
    if not found or words & STATES:
        return False
    return not (found <= LAYOUT_NAMES and words & CONTENT_NAMES and (found == {"header"} or words & WRAPS))


def _noise(tag: str, own: dict[str, str], inside: bool) -> bool:
    """Whether an element names itself as something else than content; ``inside`` an article or main element."""
    if tag in ROOTS:
        return False
    if tag in NOISE_TAGS or tag == "header" and not inside:
        return True
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(own.get("style", "")):
        return True
    if own.get("role", "").lower() in NOISE_ROLES:
        return True
    names = f"{own.get('class', '')} {own.get('id', '')}".split()
    said = [n for n in names if _noise_name(n)]
    if tag == "article":  # themes add words on the page to an article's names
        return any(n.lower() in NOISE_NAMES or n.lower().startswith("comment") for n in said)
    return bool(said) and (tag not in ALWAYS or len(said) == len(names))


def nodes(html: str) -> Iterator[Node]:
    """Text nodes of a page in page order, without those in elements that are no content."""
    stack: list[tuple[str, str, bool, bool]] = []  # tag, name in the path, noise, within an article or main element
    link, at, end = 0, 0, len(html)
    node: Node | None = None

    def add(raw: str) -> None:
        nonlocal node
        if stack and stack[-1][2] or not raw:
            return
        if node is None:
            path = tuple(s[1] for s in stack)
            node = Node(paths.setdefault(path, path), stack[-1][0] if stack else "")
        text = unescape(raw) if "&" in raw else raw
        node.parts.append(text)
        if link:
            node.linked += len(text.strip())

    def close() -> Node | None:
        nonlocal node
        done, node = node, None
        if done is not None:
            done.text = " ".join("".join(done.parts).split())
        return done if done is not None and done.text else None

    paths: dict[tuple[str, ...], tuple[str, ...]] = {}
    unclosed: set[str] = set()
    last = html.rfind(">")

    def closing_tag(name: str, start: int) -> int:
        """End of the next closing tag of this name, or -1; a search that failed is not repeated."""
        if name in unclosed:
            return -1
        found = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, start)
        if not found:
            unclosed.add(name)
        return found.end() if found else -1

    while at < end:
        found = _OPEN.search(html, at)
        if not found:
            add(html[at:])
            break
        begin = found.start()
        if found[0] == "<!--":
            add(html[at:begin])
            stop = html.find("-->", begin + 4)
            at = end if stop < 0 else stop + 3
            continue
        if begin > last:  # no tag ends any more: text, up to a comment
            stop = html.find("<!--", begin)
            add(html[at : stop if stop >= 0 else end])
            break
        add(html[at:begin])
        if found[0] in ("<!", "<?"):
            at = html.find(">", begin) + 1
            continue
        named = _NAMED.match(html, begin)
        closing, tag = named[1], named[2].lower()
        rest = _ATTRIBUTES.match(html, named.end())
        if rest:
            raw, at = rest[1], rest.end()
        else:
            stop = html.find(">", named.end())
            raw, at = html[named.end() : stop], stop + 1
        if tag in RAW:
            if not closing:
                stop = closing_tag(tag, at)
                at = end if stop < 0 else stop
            continue
        if tag in INLINE:
            if tag == "a":
                link = not closing
            own = _attributes(raw) if raw and not closing else {}
            if own and ("hidden" in own or _HIDDEN.search(own.get("style", ""))):
                at = max(at, closing_tag(tag, at))
            continue
        if done := close():
            yield done
        if tag in VOID:
            continue
        if closing:
            if any(s[0] == tag for s in stack):
                while stack.pop()[0] != tag:
                    pass
                link = 0
            continue
        if tag in ENDS_PARAGRAPH and stack and stack[-1][0] == "p":
            stack.pop()
        while tag in SIBLINGS and stack and stack[-1][0] in SIBLINGS[tag] | {"p"}:
            stack.pop()
        if len(stack) >= DEPTH:
            stack.pop()
        own = _attributes(raw)
        inside = bool(stack and stack[-1][3])
        noise = bool(stack and stack[-1][2]) or _noise(tag, own, inside)
        name = tag + "".join("." + c for c in own.get("class", "").lower().split()) if tag in ("div", "section") else tag
        stack.append((tag, name, noise, inside or tag in CONTENT_TAGS))
    if done := close():
        yield done


def _smooth(values: list[float]) -> list[float]:
    """Weighted mean with both neighbours."""
    padded = [values[0], *values, values[-1]]
    return [(a + 2 * b + c) / 4 for a, b, c in zip(padded, padded[1:], padded[2:])]


def main_text(html: str, threshold: float = 0.1, share: float = 0.85) -> str:
    """Content nodes of a page, joined by one space."""
    found = list(nodes(html))
    if not found:
        return ""
    total: dict[tuple[str, ...], list[float]] = {}
    for n in found:
        own = total.setdefault(n.path, [0, 0, 0, 0])
        for i, x in enumerate((1, max(0, len(n.text) - n.linked), len(_PUNCTUATION.findall(n.text)), n.linked)):
            own[i] += x
    lengths = _smooth([total[n.path][1] / total[n.path][0] for n in found])
    marks = _smooth([total[n.path][2] / total[n.path][0] for n in found])
    fused: dict[tuple[str, ...], float] = {}
    for n, a, b in zip(found, lengths, marks):
        fused[n.path] = fused.get(n.path, 0) + a * (1 + b) / total[n.path][0]

    def named(path: tuple[str, ...]) -> int:
        return sum(p in CONTENT_TAGS or bool(set(p.split(".")[1:]) & CONTENT_NAMES) for p in path)

    weight = {p: fused[p] * total[p][1] * (20 if named(p) else 1) for p in fused}
    holds: dict[tuple[str, ...], float] = {}
    for path, w in weight.items():
        for k in range(len(path) + 1):
            holds[path[:k]] = holds.get(path[:k], 0) + w
    whole = holds[()]
    inner = max((p for p, w in holds.items() if w >= share * whole and (not p or p[-1].split(".")[0] not in ALWAYS)), key=len)
    # what encloses the content element as article or main is wholly the article; the innermost such element counts
    inner = next((inner[:k] for k in range(len(inner), 0, -1) if inner[k - 1] in CONTENT_TAGS), inner)
    best = max(fused.values())
    article = any(p in CONTENT_TAGS for p in inner)

    def content(path: tuple[str, ...], tag: str) -> bool:
        _, plain, _, linked = total[path]
        if path[: len(inner)] != inner:
            return False
        shift = 0 if article or tag in ALWAYS or path == inner else 1
        return fused[path] >= shift * threshold * best and (article or tag in HEADINGS or linked <= plain)

    return " ".join(n.text for n in found if content(n.path, n.tag))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches):
        for batch in blocks(batches, "html"):
            text = [main_text(html) for html in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return given.mapInArrow(run, "page_id long, url string, text string, n_chars long")
