"""Main text of web pages by union-free wrapper inference.

A page becomes a token stream: block tags with their class, id and role, text slots, and
end tags (missing ends are supplied as HTML prescribes, inline tags dissolve). The streams
of one host are aligned into a wrapper, an expression of nested elements without unions:
where streams differ, an element that one lacks becomes optional, a run of one or several
elements that recurs at once becomes a repeated group, and differing text becomes a slot;
text that is equal on all pages stays a constant. The alignment of two wrappers is a
wrapper, so pages are folded within map tasks, these results within salted groups, and
those into one wrapper for each host: a host with a third of all pages is never gathered
in a task.

A wrapper is of bounded size whatever its pages hold: below ``MAX_DEPTH`` levels, in an
element of over ``MAX_CHILDREN`` kinds of children, and beyond ``MAX_NODES`` in all, an
element is a summary that counts what is below it, all characters of it, without parts.

A wrapper's elements carry what was seen in them: pages, characters, characters in links
and whether their text is constant. From these follow the rules of the host: its content
root, and elements below it that are not content. Menus, asides, footers, dialogs and
hidden elements go by their tag or role. Class and id words (``sidebar``, ``cookie-notice``)
and forms are a prior that the wrapper overrules where such an element holds most of the
host's running text. Outside an article, elements that are links for the most part go where
several pages or several links say so, and so do constants of at least ``CONSTANT_PAGES``
pages that differ in their text: each is a path with the hash of the whole text, and
other text on that path stays. A rule is a path of keys; pages are joined with the rules
of their host, and the text of each page is taken from its stream by them. A page that
would lose all its text to a root, to constants or to the prior keeps what these took.

Defined cases: a null or empty html has empty text; a null or odd url is a host of its
own name, the empty string; a page without the host's root gives its whole body under
the same rules; pages cut off inside a tag or a character reference keep what was read;
tags may nest to any depth; script and style without an end run to the end of the page,
other raw elements without one end at the next tag; repeated rows weigh on the wrapper,
but are one page to constants, and each give their text; an empty table gives an empty
result; other columns pass through ``extract`` untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, table

SALTS, CONSTANT_PAGES, LINK_SHARE, ROOT_SHARE, PRIOR_SHARE = 32, 3, 0.6, 0.5, 0.5
MAX_DEPTH, MAX_CHILDREN, MAX_NODES, MAX_PERIOD = 48, 60, 2_000, 6
#: Elements by their role in a page.
_RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
_SKIP = frozenset("noscript template svg canvas object select button audio video map datalist applet".split())
_VOID = frozenset("area base basefont bgsound col embed frame img input link meta param source track wbr".split())
_HEAD = frozenset("base basefont bgsound link meta noscript script style template title head html".split())
_BLOCK = frozenset(
    "html head body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption "
    "header footer nav aside form fieldset legend address details summary dialog menu center search hgroup option optgroup".split()
)
_NOT_CONTENT = frozenset("nav footer aside dialog menu search".split())
_PRIOR = frozenset("form header fieldset address".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar side aside rail widget widgets related recommended recommendations share sharing social "
    "comment comments disqus reply replies respond discussion newsletter subscribe subscription signup login search pagination pager toolbar copyright legal disclaimer skip toc tags".split()
)
#: Words of a name that say what an element is for, and such that say nothing about it.
_CONTENT = frozenset("article articles content post posts entry story stories text body main news blog page paper recipe chapter lead intro summary product description".split())
_NEUTRAL = frozenset("container wrapper wrap box block area section list item items inner outer bar row col column left right top bottom panel module group links link buttons holder region body content text".split())
_STATES = frozenset("has no with without is not js hide show".split())
#: A start tag of a kind ends an open element of the kinds named, unless a barrier is between.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th", "caption"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup")}
_ENDS |= dict.fromkeys(("thead", "tbody", "tfoot"), ("thead", "tbody", "tfoot", "tr", "td", "th", "caption"))
_BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}
_CELLS = frozenset("table td th caption template object".split())
_TABLE = frozenset("table thead tbody tfoot tr td th caption".split())
_ATTRIBUTE_TEXT = r"""(?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))?+|=)"""
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTE_TEXT}*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>]*+)))?+""")
#: Marks of the begin and end of a link among an element's children.
_LINK, _LINK_END = 1, -1


@dataclass
class Element:
    """A node of a page or of a wrapper; children are elements, and in pages strings and link marks."""

    key: str
    children: list = field(default_factory=list)
    pages: int = 1
    chars: int = 0
    links: int = 0
    constant: str | None = None  #: the text, where all have the same; a hash of a long one
    texts: list = field(default_factory=list)  #: the least hashes of pages that have text here, CONSTANT_PAGES at most
    optional: bool = False
    repeated: bool = False
    summary: bool = False


def _key(tag: str, attributes: str) -> str:
    """A tag with its id and class words (#, .), role (@), and a mark where it is hidden."""
    if not attributes.strip(" /\t\r\n\f"):
        return tag
    named: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        named.setdefault(m[1].lower(), next((x for x in m.groups()[1:] if x is not None), ""))
    marks = [tag]
    for name, sign in (("id", "#"), ("class", "."), ("role", "@")):
        words = {"-".join(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", token).lower())) for token in named.get(name, "").split()}
        marks += [sign + w for w in sorted(words - {""})]
    if "hidden" in named or named.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", named.get("style", ""), re.I):
        marks.append("!hidden")
    return "".join(marks)


def _tag(key: str) -> str:
    return re.split(r"[#.@!]", key, maxsplit=1)[0]


class _Builder:
    """The open elements of a page while its tokens are read."""

    def __init__(self):
        self.root = Element("")
        self.stack, self.tags, self.open = [self.root], [""], Counter()

    def push(self, tag: str, key: str) -> None:
        child = Element(key)
        self.stack[-1].children.append(child)
        self.stack.append(child)
        self.tags.append(tag)
        self.open[tag] += 1

    def pop_to(self, i: int) -> None:
        self.open.subtract(self.tags[i:])
        del self.stack[i:], self.tags[i:]

    def find(self, names: tuple[str, ...], barriers: frozenset[str] | set[str]) -> int:
        """The place of the innermost open element of these names that no barrier covers, else 0."""
        if not any(self.open[n] for n in names):
            return 0
        for i in range(len(self.tags) - 1, 0, -1):
            if self.tags[i] in names:
                return i
            if self.tags[i] in barriers:
                return 0
        return 0

    def text(self, raw: str) -> None:
        if self.open["head"] and raw.strip():
            self.pop_to(self.tags.index("head"))
        self.stack[-1].children.append(html.unescape(raw))

    def start(self, tag: str, attributes: str) -> None:
        if self.open["head"] and tag not in _HEAD:
            self.pop_to(self.tags.index("head"))
        if tag == "a":
            self.stack[-1].children.append(_LINK)
        elif tag == "br":
            self.stack[-1].children.append(" ")
        elif tag == "hr":
            self.start("p", "")
            self.pop_to(len(self.tags) - 1)
        elif tag in _SKIP:
            if tag == "button" and (i := self.find(("button",), _CELLS)):
                self.pop_to(i)
            self.push(tag, tag)
            if attributes.rstrip().endswith("/"):
                self.pop_to(len(self.tags) - 1)
        elif tag in _BLOCK and not (tag in ("html", "head", "body") and self.open[tag]):
            if tag not in ("option", "optgroup") and (i := self.find(("button", "select", "datalist"), _CELLS)):
                self.pop_to(i)  # left open by mistake
            if i := self.find(("p",), _CELLS):
                self.pop_to(i)
            while tag in _ENDS and (i := self.find(_ENDS[tag], _BARRIER.get(tag, {"table", "template"}))):
                self.pop_to(i)
            if tag[0] == "h" and tag[1:].isdigit() and self.tags[-1][:1] == "h" and self.tags[-1][1:].isdigit():
                self.pop_to(len(self.tags) - 1)
            self.push(tag, _key(tag, attributes))

    def end(self, tag: str) -> None:
        if tag == "a":
            self.stack[-1].children.append(_LINK_END)
        elif tag == "br":
            self.stack[-1].children.append(" ")
        elif self.open[tag] and tag not in ("html", "body"):
            if i := self.find((tag,), {"table", "template"} - {tag} if tag in _TABLE else _CELLS - {tag}):
                self.pop_to(i)


def parse(source: str) -> Element:
    """The tree of a page's block elements, built without recursion; text is unescaped."""
    page, at, n = _Builder(), 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if text := source[at : m.start() if m else n]:
            page.text(text)
        if m is None:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            page.end(tag)
        elif tag in _RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            if page.open["head"] and tag not in _HEAD:
                page.start(tag, "")
            if close:
                if tag == "xmp":
                    page.stack[-1].children.append(source[at : close.start()])
                at = close.end()
            elif tag in ("script", "style"):
                break
        elif tag == "plaintext":
            page.stack[-1].children.append(source[at:])
            break
        else:
            page.start(tag, m[3])
    return page.root


def _block(parts: list) -> tuple[str, int]:
    """Text of one block with single spaces, and how many of its characters stand in links."""
    if len(parts) == 1 and isinstance(parts[0], str):
        return " ".join(parts[0].split()), 0
    raw, linked, inside = [], 0, False
    for x in parts:
        if isinstance(x, str):
            raw.append(x)
            linked += len(" ".join(x.split())) if inside else 0
        else:
            inside = x == _LINK
    return " ".join("".join(raw).split()), linked


def _hash(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _constant(own: str) -> str:
    return own if len(own) <= 200 else "\0" + _hash(own)


def _everything(page: Element) -> Iterator:
    """All strings and link marks at and below an element, in order, outside what is never content."""
    todo = [page]
    while todo:
        x = todo.pop()
        if isinstance(x, Element):
            if x.key not in _SKIP:
                todo += reversed(x.children)
        else:
            yield x


def to_wrapper(page: Element, text_hash: str | None = None, depth: int = 0) -> Element:
    """A page as a wrapper: what recurs at once is a repeated group, texts are counted."""
    text_hash = text_hash or _hash(" ".join("".join(x for x in _everything(page) if isinstance(x, str)).split()))
    out = Element(page.key)
    if depth >= MAX_DEPTH:
        text = list(_everything(page))
        out.summary = True
    else:
        text = [x for x in page.children if not isinstance(x, Element)]
        out.children = [to_wrapper(c, text_hash, depth + 1) for c in page.children if isinstance(c, Element) and c.key not in _SKIP]
    own, links = _block(text)
    out.chars, out.links, out.constant = len(own), links, _constant(own) if own and not out.summary else None
    out.texts = [text_hash] if own else []
    out.children = _fold(out.children)
    return out if len(out.children) <= MAX_CHILDREN else _summarise(out)


def _summarise(e: Element) -> Element:
    """An element without its parts, whose characters it counts as its own."""
    for c in e.children:
        c = _summarise(c)
        e.chars, e.links = e.chars + c.chars, e.links + c.links
        e.texts = sorted({*e.texts, *c.texts})[:CONSTANT_PAGES]
    e.children, e.constant, e.summary = [], None, True
    return e


def _fold(children: list[Element]) -> list[Element]:
    """Runs of one or several elements that recur at once become one repeated group, shorter ones first."""
    for period in range(1, MAX_PERIOD + 1):
        if len(children) < 2 * period:
            break
        keys, out, i = [c.key for c in children], [], 0
        while i < len(children):
            group = children[i : i + period]
            j = i + period
            while len(group) == period and keys[j : j + period] == keys[i : i + period]:
                group = [_merge(a, b, within_page=True) for a, b in zip(group, children[j : j + period], strict=True)]
                j += period
            if j > i + period:
                for g in group:
                    g.repeated = True
                out += group
                i = j
            else:
                out.append(children[i])
                i += 1
        children = out
    return children


def _merge(a: Element, b: Element, within_page: bool = False) -> Element:
    """The alignment of two wrappers of one key."""
    if a.summary != b.summary:
        a, b = (x if x.summary else _summarise(x) for x in (a, b))
    out = Element(a.key, pages=max(a.pages, b.pages) if within_page else a.pages + b.pages, chars=a.chars + b.chars, links=a.links + b.links)
    out.constant = a.constant if a.constant == b.constant else None
    out.texts = sorted({*a.texts, *b.texts})[:CONSTANT_PAGES]
    out.optional, out.repeated, out.summary = a.optional or b.optional, a.repeated or b.repeated, a.summary
    out.children = _fold(list(_align(a.children, b.children)))
    return out if len(out.children) <= MAX_CHILDREN else _summarise(out)


def _align(a: list[Element], b: list[Element]) -> Iterator[Element]:
    """A longest common subsequence of keys; what only one side has becomes optional."""
    n, m = len(a), len(b)
    if n == m and all(x.key == y.key for x, y in zip(a, b, strict=True)):
        yield from map(_merge, a, b)
        return
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i].key == b[j].key else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and a[i].key == b[j].key:
            yield _merge(a[i], b[j])
            i, j = i + 1, j + 1
            continue
        left = j == m or (i < n and best[i + 1][j] >= best[i][j + 1])
        element = a[i] if left else b[j]
        element.optional = True
        yield element
        i, j = i + left, j + (not left)


def _count(e: Element) -> int:
    return 1 + sum(map(_count, e.children))


def _bound(e: Element) -> Element:
    """A wrapper of at most MAX_NODES elements: its deepest levels become summaries."""
    depth = MAX_DEPTH
    while _count(e) > MAX_NODES and depth:
        depth //= 2

        def cut(x: Element, level: int, depth: int = depth) -> None:
            for c in x.children:
                _summarise(c) if level + 1 >= depth and c.children else cut(c, level + 1)

        cut(e, 0)
    return e


def _dump(e: Element) -> list:
    return [e.key, e.pages, e.chars, e.links, e.constant, int(e.optional), int(e.repeated), int(e.summary), [_dump(c) for c in e.children], e.texts]


def _load(x: list) -> Element:
    return Element(x[0], [_load(c) for c in x[8]], x[1], x[2], x[3], x[4], x[9], bool(x[5]), bool(x[6]), bool(x[7]))


def align(wrappers: Iterator[str]) -> str | None:
    """One wrapper out of many, as text."""
    out: Element | None = None
    for w in wrappers:
        out = _load(json.loads(w)) if out is None else _bound(_merge(out, _load(json.loads(w))))
    return None if out is None else json.dumps(_dump(_bound(out)), ensure_ascii=False)


def _purpose(token: str) -> int:
    """-1 where a class or id token names something beside the content, 1 where it names content, else 0."""
    words = token.split("-")
    if words[0] in _STATES:
        return 0
    while len(words) > 1 and words[-1] in _NEUTRAL:
        words.pop()
    return -1 if words[-1] in _NAMES else int(words[-1] in _CONTENT)


def _away(key: str, in_article: bool) -> int:
    """2 for what is never content by tag, role or visibility, 1 for what a name or a form suggests, else 0."""
    tag, role = _tag(key), key.partition("@")[2].partition("!")[0]
    if key.endswith("!hidden"):
        return 2
    if tag in ("", "html", "body", "main", "article"):
        return 0
    if tag in _NOT_CONTENT or role in _ROLES:
        return 2
    purposes = [_purpose(t) for t in re.split(r"[#.]", key.partition("@")[0].partition("!")[0])[1:]]
    if tag == "header" and in_article:  # an article's own heading
        return int(any(p < 0 for p in purposes) and "header" not in key.partition(".")[2])
    if tag in _PRIOR:
        return 1
    return int(min(purposes, default=0) < 0 and max(purposes) <= 0)


def rules(wrapper: Element) -> dict:
    """root: the path of the content root; drop: what is not content.

    A path that is dropped whatever a page holds has no mark, one that a page keeps if it
    has nothing else begins with ``?``; a constant is a path, \\0 and its hash; below a path
    that begins with ``*`` the wrapper has no parts, and the prior holds for each page.
    """
    drop: list[str] = []
    totals: dict[str, int] = {}
    articles: dict[str, int] = {}
    constant = lambda e: e.constant is not None and len(e.texts) >= CONSTANT_PAGES
    running = lambda e: (0 if constant(e) else e.chars - e.links) + sum(map(running, e.children)) if _away(e.key, False) < 2 else 0
    overall = running(wrapper)

    def walk(e: Element, path: str, in_article: bool) -> tuple[int, int, int, set]:
        """Characters of content and of links at and below e, how many blocks are links, and pages that have text here."""
        article = in_article or _tag(e.key) in ("article", "main") or "@main" in e.key
        away = _away(e.key, in_article) if path else 0
        if away == 1 and running(e) >= PRIOR_SHARE * overall > 0:
            away = 0  # the wrapper knows better: most of the host's running text is here
        if away:
            drop.append(("?" if away == 1 else "") + path)
            return 0, 0, 0, set()
        chars, links, children, pages = e.chars, e.links, 0, set(e.texts)
        blocks = (2 if e.repeated else 1) * (e.chars > 0 and e.links > LINK_SHARE * e.chars)
        for c in e.children:
            x, y, z, seen = walk(c, f"{path}>{c.key}" if path else c.key, article)
            chars, links, children, blocks, pages = chars + x, links + y, children + x, blocks + z, pages | seen
        if e.summary and path:
            drop.append("*" + path)
        if path and _tag(e.key) not in ("html", "body") and not article:
            if constant(e) and not children:
                drop.append(f"{path}\0{_hash(e.constant)}")
                return 0, 0, 0, set()
            if chars and links > LINK_SHARE * chars and (blocks > 1 or len(pages) > 1):
                drop.append("?" + path)
                return 0, 0, 0, set()
        totals[path] = chars
        if article and not in_article:
            articles[path] = articles.get(path, 0) + chars
        return chars, links, blocks, pages

    everything = walk(wrapper, "", False)[0]
    root = ""
    if articles and max(articles.values()) >= ROOT_SHARE * everything:
        root = max(sorted(articles), key=lambda p: articles[p])
    else:  # the deepest element that holds most of the content
        for path, chars in sorted(totals.items()):
            if chars >= 0.8 * everything > 0 and len(path) > len(root) and _tag(path.rpartition(">")[2]) in ("body", "div", "section", "main", "article", "td"):
                root = path
    return {"root": root, "drop": sorted(set(drop))}


def take(page: Element, root: str, drop: frozenset[str]) -> str:
    """The text of a page by the rules of its host: blocks in page order."""
    constants = {d.partition("\0")[0] for d in drop if "\0" in d}

    def blocks(root: str, constant: bool, prior: bool) -> Iterator[str]:
        # what is left to do, last first: an element's parts, each with its path ("" below MAX_DEPTH), place and element
        todo: list[tuple] = [(iter(page.children), "", not root, False, False, page)]
        text: list = []

        def close(inside: bool, e: Element, path: str) -> Iterator[str]:
            if text:
                own = _block(text)[0]
                text.clear()
                if inside and own and not (constant and path in constants and f"{path}\0{_hash(_constant(_block([c for c in e.children if not isinstance(c, Element)])[0]))}" in drop):
                    yield own

        while todo:
            parts, path, inside, article, loose, e = todo[-1]
            for c in parts:
                if not isinstance(c, Element):
                    text.append(c)
                    continue
                yield from close(inside, e, path)
                below = f"{path}>{c.key}" if path else c.key
                if loose or len(todo) > MAX_DEPTH:
                    away, below, free = _away(c.key, article), path, True
                else:
                    away, free = 2 if below in drop else int("?" + below in drop), "*" + below in drop
                if c.key in _SKIP or away == 2 or (away == 1 and prior):
                    continue
                main = article or _tag(c.key) in ("article", "main") or "@main" in c.key
                todo.append((iter(c.children), below, inside or below == root, main, free, c))
                break
            else:
                yield from close(inside, e, path)
                todo.pop()

    found: list[str] = []
    for root_, constant, prior in ((root, True, True), ("", True, True), (root, False, True), ("", False, True), ("", False, False)):
        found = list(blocks(root_, constant, prior))
        if found:
            break
    return "\n".join(found)


def host() -> Column:
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def host_rules(pages: DataFrame) -> DataFrame:
    """host, root, drop: one row for each host, by aligning all of its pages."""

    def fold_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, Element] = {}
        for b in batches:
            for name, source in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                w = _bound(to_wrapper(parse(source.as_py())))
                own[name] = _bound(_merge(own[name], w)) if name in own else w
            if len(own) > 2_000:
                yield dumped(own)
                own = {}
        yield dumped(own)

    def dumped(own: dict[str, Element]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(own), pa.string()), pa.array([json.dumps(_dump(w), ensure_ascii=False) for w in own.values()], pa.string())], names=["host", "wrapper"])

    def fold(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "wrapper": [align(iter(sorted(group["wrapper"])))]})

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [rules(_load(json.loads(w.as_py()))) for w in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array([r["root"] for r in found], pa.string()), pa.array([r["drop"] for r in found], pa.list_(pa.string()))], names=["host", "root", "drop"])

    parts = pages.where(F.coalesce(F.col("html"), F.lit("")) != "").select(host().alias("host"), "html").mapInArrow(fold_pages, "host string, wrapper string")
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    few = salted.groupBy("host", "salt").applyInPandas(fold, "host string, wrapper string")
    one = few.groupBy("host").applyInPandas(fold, "host string, wrapper string")
    return one.mapInArrow(decide, "host string, root string, drop array<string>")


def extract(pages: DataFrame) -> DataFrame:
    """pages with a column ``text``: the main text of html."""
    known = materialize(host_rules(pages), "rules")

    @F.pandas_udf("string")
    def taken(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, roots, drops in parts:
            yield pd.Series([take(parse(s), r or "", frozenset(d) if d is not None else frozenset()) if s else "" for s, r, d in zip(sources, roots, drops, strict=True)], dtype="object")

    of, own, root, drop = fresh([*pages.columns, "text"], "of", "host", "root", "drop")
    named = known.select(F.col("host").alias(own), F.col("root").alias(root), F.col("drop").alias(drop))
    joined = pages.withColumn(of, host()).join(named, F.col(of) == F.col(own), "left")
    return joined.withColumn("text", taken("html", root, drop)).drop(of, own, root, drop)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
