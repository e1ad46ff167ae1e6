"""Main text of web pages with wrappers inferred for each host.

*Labels.* A page is a tree of elements and texts. An element's label is its tag with its
classes and id, numbers in them left out of account, if at least SUPPORT pages of the host
and one in RARE have it; else its tag alone. So generated names leave no trace, and a
wrapper stays as small as a page.

*Wrapper.* Pages of a host are aligned one after another. Equal neighbours fold into a
repeated group; a text that differs becomes a slot; what one page has and another lacks
becomes optional. The result is a regular expression without unions: tags, fixed texts,
slots, ``( )+`` and ``( )?``. Each element of it also counts the text that the host's pages
have there, and how much of that is links. Alignment depends on order, so the order is
fixed: pages go by a hash of their html, BUCKET or so of the nearest hashes into one
wrapper, then 64 neighbouring wrappers into one, until one is left. A host's wrapper
depends on its pages only, not on tasks, partitions or the order of rows, and no task gets
more than some pages or 64 wrappers of a host.

*Extraction.* Every page is aligned with its host's wrapper. The wrapper says where
the main text lies: from the root down it goes on into an article or main element that
holds half of the text (links not counted), or into the element that holds nearly all of
it, as long as what stands beside it is no paragraph or headline. It says what in there is
template, a text other than a headline that ``SUPPORT`` different pages have while no page
has another in its place, and what is a menu, a list that is nearly all links; where that
would leave less than LEAST per cent, the host's pages are copies, and all stays. A fixed
headline stays if text follows it. Parts that the wrapper lacks count as content. Hosts with
fewer different pages than ``SUPPORT`` have too little to align: there the article elements,
or else the main element, or else the body are the main text.

*Names.* Tags, roles and names of elements say what is a header, footer, sidebar, notice,
advert, form or comment section, as these differ from page to page like the text does. A
class or id counts if its last word is listed (NAMES, COMMENTS) and none is one of STATING, or
if all its words are listed or neutral (NEUTRAL): ``sidebar``, ``cookie-notice``,
``reader-comments``, ``sidebar-left``, but not ``no-sidebar``, ``menu-open`` or ``related-work``.
Names, form and header never hide an element that holds the article or main element, and
only those of comments one that holds more than half of the page's text.

Elements nested deeper than ``MAX_DEPTH`` are read as children of the element there. Lists of
labels are aligned by longest common subsequence, those whose lengths' product is beyond TABLE
by the order in which each label occurs. Defined results: a null page or one without main text
gives an empty text; pages without a host share one wrapper; repeated rows give equal rows and
support nothing anew; columns called text or n_chars are replaced, others pass through, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .store import Scratch

#: Different pages of a host that must have a text for it to be template text.
SUPPORT = 3
#: One page in so many must have a label for it to count.
RARE = 20
#: Pages of neighbouring hashes that are aligned to one wrapper, about; and how many bits of a bucket's number each further round takes off.
BUCKET, ROUND_BITS = 64, 6
#: What is known of hosts is broadcast up to so many bytes of all together.
MAX_WRAPPER_BYTES = 32 << 20
#: Levels of a page's tree.
MAX_DEPTH = 200
#: Share of the text that an element must hold to be gone into, and of a list's that must be links to make it a menu, in percent.
MOST, LINKS = 80, 90
#: Share of the main text, in percent, that must be left when its template is taken away; else nothing is.
LEAST = 20
#: Places that two lists of labels are aligned over exactly, by a table; beyond that by the order in which each label occurs.
TABLE = 1 << 20

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_REST = re.compile(r"(?>[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*>")  # a quote opens a value only after the sign
_ATTRIBUTE = re.compile(r"(?:^|(?<=[\s/\"']))([^\s=/\"'>]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME = re.compile(r"[a-z0-9]+")
_NUMBER = re.compile(r"\d+")

# Elements by what they mean for the main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var".split())
DROPPED = frozenset("nav footer aside script style noscript template button select option textarea input dialog menu iframe object svg canvas audio video map head title datalist".split())
#: Of these kinds only if they don't hold the main text.
DOUBTFUL = frozenset("form fieldset".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promotion banner sidebar menu nav navbar navigation"
    " breadcrumb breadcrumbs footer cookie cookies consent notice notices popup modal newsletter subscribe subscription signup login share sharing social related"
    " recommended recommendations widget widgets toolbar pagination pager search skip".split()
)
COMMENTS = frozenset("comment comments commentlist respond reply replies disqus".split())
NEUTRAL = frozenset(
    "site page main top bottom left right head foot post entry article list box block wrapper wrap container inner outer area section slot bar item items text content body column col row primary"
    " secondary global mobile desktop sticky fixed floating inline js div group panel module unit region links link icons buttons button form title".split()
)
STATING = frozenset("no not non has have with without hide hides hidden is show shows toggle open".split())
HEADLINES = frozenset("h1 h2 h3 h4 h5 h6 dt th caption summary".split())
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
CONTAINERS = frozenset("#root html body main article section div center table tbody tr td".split())
LISTS = frozenset("ul ol dl div section table".split())
#: An element that ends an open one of these, up to one of those.
IMPLIED_END = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}


#: What speaks against an element: nothing, its name or kind, the name of comments.
NONE, NAMED, COMMENT = range(3)


class Node:
    __slots__ = ("tag", "label", "dropped", "doubt", "children", "linked")

    def __init__(self, tag: str, label: str, dropped: bool, doubt: int = NONE):
        self.tag, self.label, self.dropped, self.doubt, self.children, self.linked = tag, label, dropped, doubt, [], 0


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if "=" in raw else {}


def _is_dropped(tag: str, attributes: dict[str, str], raw: str) -> bool:
    """Hidden, or of a kind that is never main text."""
    if tag in DROPPED:
        return True
    if not attributes and "hidden" not in raw:
        return False
    if attributes.get("role", "").lower() in DROPPED_ROLES or attributes.get("aria-hidden", "").lower() == "true":
        return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|$|=)", raw, re.I)) and "hidden" not in attributes.get("class", "").lower().split() or "display:none" in attributes.get("style", "").replace(" ", "").lower()


@lru_cache(4096)
def _said(names: str, in_article: bool) -> int:
    """What classes and ids say: those whose last word is listed, if no other states something of it, or whose words are all listed or neutral."""
    found = NONE
    for token in names.split():
        words = [w for w in _NAME.findall(token) if not w.isdigit()]
        listed = [w in NAMES or w in COMMENTS or (w == "header" and not in_article) for w in words]
        if words and (listed[-1] and not any(w in STATING for w in words) or any(listed) and all(x or w in NEUTRAL for x, w in zip(listed, words))):
            if any(w in COMMENTS for w in words):
                return COMMENT
            found = NAMED
    return found


def _doubt(tag: str, attributes: dict[str, str], in_article: bool) -> int:
    if tag in ("html", "body", "main"):
        return NONE
    said = _said(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower(), in_article) if "class" in attributes or "id" in attributes else NONE
    if tag == "article":
        return said if said == COMMENT else NONE
    return NAMED if said == NONE and (tag in DOUBTFUL or tag == "header" and not in_article) else said


def _settle(root: Node) -> None:
    """Drop what is doubtful, but for what holds the main text."""
    sizes: dict[int, int] = {}
    mains: dict[int, int] = {}  # article and main elements within that nothing speaks against, and those within comments

    def measure(node: Node) -> tuple[int, int, int]:
        size, own, among = -node.linked, 0, 0
        for c in node.children:
            if isinstance(c, str):
                size += len(c) - c.count(" ")
            elif not c.dropped:
                s, o, m = measure(c)
                size, own, among = size + s, own + o, among + m
        if node.doubt == COMMENT:
            own, among = 0, own + among
        elif node.tag in ("article", "main") and size > 0:
            own += 1
        sizes[id(node)], mains[id(node)] = size, own + among
        return size, own, among

    total, clear, _ = measure(root)

    def decide(node: Node) -> None:
        for c in node.children:
            if isinstance(c, str) or c.dropped:
                continue
            if c.doubt == COMMENT:
                c.dropped = bool(clear) or not (mains[id(c)] or c.tag == "article" and 2 * sizes[id(c)] > total)
            elif c.doubt == NAMED:
                c.dropped = not (mains[id(c)] or 2 * sizes[id(c)] > total)
            if not c.dropped:
                decide(c)

    decide(root)


def _tags(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """Start, end, name (None: a comment or the like), whether it closes, and attributes of every tag, in linear time."""
    at, last, quotes, wasted = 0, page.rfind(">"), True, 0
    while at <= last:
        m = _TOKEN.search(page, at)
        if m is None or (m[2] is not None and m.end() > last):
            return
        end = m.end()
        if m[2] is not None:
            rest = _REST.match(page, end) if quotes else None
            if rest is None and quotes:  # a quote that never closes
                wasted += len(page) - end
                quotes = wasted <= 8 * len(page)
            end = rest.end() if rest else page.index(">", end) + 1
        yield m.start(), end, m[2], bool(m[1]), page[m.end() : end - 1] if m[2] is not None else ""
        at = end


def _label(tag: str, attributes: dict[str, str]) -> str:
    return " ".join([tag, *sorted(_NUMBER.sub("0", attributes.get("class", "")).split()), *(["#" + _NUMBER.sub("0", attributes["id"])] if attributes.get("id") else [])])


def parse(page: str, labels: frozenset | set | None = None) -> Node:
    """A lenient tree; markup within text (bold, links) leaves no trace in it but how much text is linked.

    labels: those that count; an element with any other is known by its tag.
    """
    root = Node("#root", "#root", False)
    stack = [root]
    deep: list[tuple[str, bool]] = []  # open elements beyond MAX_DEPTH, and whether they are dropped
    at, skip, linked, muted = 0, 0, False, 0

    def close_to(tags: frozenset | tuple | list, until: tuple | list) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in until:
                return

    def add_text(text: str) -> None:
        if text and not muted:
            stack[-1].children.append(text)
            if linked:
                stack[-1].linked += len("".join(text.split()))

    for start, end, name, closes, raw in _tags(page):
        if start < skip:
            continue
        add_text(page[at:start])
        at = end
        if name is None:
            continue
        tag = name.lower()
        if tag == "a":
            linked = not closes
        if closes:
            if deep:
                while any(t == tag for t, _ in deep[-MAX_DEPTH:]):
                    t, d = deep.pop()
                    muted -= d
                    if t == tag:
                        break
                continue
            if tag == "p" and all(x.tag != "p" for x in stack):
                stack[-1].children.append(Node("p", "p", False))
            close_to((tag,), ())
            continue
        attributes = _attributes(raw)
        dropped = _is_dropped(tag, attributes, raw)
        doubt = NONE if dropped else _doubt(tag, attributes, any(x.tag == "article" for x in stack))
        if tag in INLINE and not dropped and not doubt:
            continue
        if not deep:
            if tag in CLOSES_PARAGRAPH:
                close_to(("p",), ("article", "section", "div", "td", "li", "body", "blockquote", "aside"))
            if tag in IMPLIED_END:
                ends, until = IMPLIED_END[tag]
                close_to(ends.split(), until.split())
        label = _label(tag, attributes) if attributes else tag
        node = Node(tag, label if labels is None or label in labels else tag, dropped, doubt)
        stack[-1].children.append(node)
        if tag in VOID or raw.rstrip().endswith("/") and tag not in RAW and tag not in ("p", "div", "article", "section"):
            continue
        if tag in RAW:
            found = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = skip = found.end() if found else len(page)
        elif len(stack) < MAX_DEPTH:
            stack.append(node)
        else:  # what is dropped hides all within, past the limit too
            deep.append((tag, dropped or doubt > NONE))
            muted += deep[-1][1]
    add_text(page[at:])
    _settle(root)
    return root


# Wrappers: [label, children, optional, repeated, size, linked, pages] for an element: characters of text in it, how many of them in links,
# and (of the root) the smallest marks, SUPPORT at most, of its pages; [None, text or null (a slot), optional, repeated, pages] for a text.


#: Texts longer than this stand in a wrapper by their digest.
_LONG = 120


def _fixed(text: str) -> str:
    return text if len(text) <= _LONG else f"#{len(text)}:{xxhash.xxh3_64_hexdigest(text)}"


def _shape(node: Node, mark: int, dropped: bool = False) -> list:
    children: list[list] = []
    dropped = dropped or node.dropped
    size, linked = 0, 0 if dropped else node.linked
    for c in node.children:
        if isinstance(c, str):
            text = " ".join(html.unescape(c).split())
            if not text:
                continue
            new = [None, _fixed(text), False, False, [mark]]
            size += 0 if dropped else len(text) - text.count(" ")
        else:
            new = _shape(c, mark, dropped)
            size, linked = size + new[4], linked + new[5]
        if children and children[-1][0] == new[0] and new[0] is not None:
            children[-1] = _merge(children[-1], new)
            children[-1][3] = True
        else:
            children.append(new)
    return [node.label, children, False, False, size, linked, [mark] if node.tag == "#root" else []]


def _aligned(a: tuple, b: tuple) -> list[tuple[int | None, int | None]]:
    """Pairs of places of two lists with one label, in order, with what is alone."""
    return _by_table(a, b) if len(a) * len(b) <= TABLE else _by_occurrence(a, b)


def _by_occurrence(a: tuple, b: tuple) -> list[tuple[int | None, int | None]]:
    """The k-th of a label in one list goes with the k-th in the other; of these pairs the longest run in order."""
    places: dict = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    used: Counter = Counter()
    ends: list[int] = []  # smallest end of an ascending run of each length
    of: list[int] = []  # and the pair it belongs to
    pairs: list[tuple[int, int, int]] = []  # place in a, place in b, the pair before
    for j, x in enumerate(b):
        own = places.get(x, ())
        if used[x] < len(own):
            i = own[used[x]]
            used[x] += 1
            k = bisect.bisect_left(ends, i)
            pairs.append((i, j, of[k - 1] if k else -1))
            ends[k : k + 1], of[k : k + 1] = [i], [len(pairs) - 1]
    run, at = [], of[-1] if of else -1
    while at >= 0:
        run.append(pairs[at][:2])
        at = pairs[at][2]
    out: list[tuple[int | None, int | None]] = []
    i = j = 0
    for x, y in [*run[::-1], (len(a), len(b))]:
        out += [(k, None) for k in range(i, x)] + [(None, k) for k in range(j, y)] + [(x, y)]
        i, j = x + 1, y + 1
    return out[:-1]


@lru_cache(4096)
def _by_table(a: tuple, b: tuple) -> list[tuple[int | None, int | None]]:
    """The longest common subsequence."""
    n, m = len(a), len(b)
    if a == b:
        return [(i, i) for i in range(n)]
    out: list[tuple[int | None, int | None]] = []
    j = 0
    for i in range(n):  # the usual case: b is part of a
        if j < m and a[i] == b[j]:
            out.append((i, j))
            j += 1
        else:
            out.append((i, None))
    if j == m:
        return out
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, x = best[i], best[i + 1], a[i]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if x == b[j] else below[j] if below[j] >= row[j + 1] else row[j + 1]
    out = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif j >= m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


def _merge(a: list, b: list) -> list:
    """Two wrappers of one label as one that accepts what either does."""
    optional, repeated = a[2] or b[2], a[3] or b[3]
    if a[0] is None:
        same = a[1] is not None and a[1] == b[1]
        return [None, a[1] if same else None, optional, repeated, (a[4] if a[4] == b[4] else sorted({*a[4], *b[4]})[:SUPPORT]) if same else []]
    children = []
    for i, j in _aligned(tuple([c[0] for c in a[1]]), tuple([c[0] for c in b[1]])):
        if i is not None and j is not None:
            children.append(_merge(a[1][i], b[1][j]))
        else:
            alone = a[1][i] if i is not None else b[1][j]
            children.append(alone if alone[2] else [alone[0], alone[1], True, *alone[3:]])
    return [a[0], children, optional, repeated, a[4] + b[4], a[5] + b[5], sorted({*a[6], *b[6]})[:SUPPORT] if a[6] or b[6] else []]


def _mark(page: str) -> int:
    return xxhash.xxh3_64_intdigest(page) >> 1


def infer(pages: list[str], wrapper: list | None = None) -> list | None:
    """The wrapper of some pages of one host, folded into what others gave; of pages that are alike one counts."""
    for page in dict.fromkeys(pages):
        own = _shape(parse(page), _mark(page))
        wrapper = own if wrapper is None else _merge(wrapper, own)
    return wrapper


def as_expression(wrapper: list) -> str:
    """The wrapper as a regular expression over tags and texts."""
    label, body, optional, repeated = wrapper[:4]
    inner = ("#TEXT" if body is None else json.dumps(body, ensure_ascii=False)) if label is None else f"<{label}>{''.join(map(as_expression, body))}</{label.split()[0]}>"
    mark = ("+" if repeated else "") + ("?" if optional else "")
    return f"({inner}){mark}" if mark else inner


def _groups(node: Node) -> list[tuple[str | None, list[int]]]:
    """Places of a node's children as the wrapper groups them: texts alone, equal neighbours together."""
    groups: list[tuple[str | None, list[int]]] = []
    for k, c in enumerate(node.children):
        if isinstance(c, str):
            if c.strip():
                groups.append((None, [k]))
        elif groups and groups[-1][0] == c.label:
            groups[-1][1].append(k)
        else:
            groups.append((c.label, [k]))
    return groups


def _is_menu(part: list) -> bool:
    return part[0].split()[0] in LISTS and part[4] > 0 and 100 * part[5] >= LINKS * part[4]


def _template(node: Node, wrapper: list, out: set[int], headlines: set[int]) -> None:
    """Places (node, child) of texts that the wrapper has as fixed, headlines apart, and of lists that are menus."""
    groups = _groups(node)
    for j, i in _aligned(tuple([c[0] for c in wrapper[1]]), tuple([g[0] for g in groups])):
        if i is None or j is None:
            continue
        part = wrapper[1][j]
        for k in groups[i][1]:
            c = node.children[k]
            if isinstance(c, str):
                if part[1] is not None and len(part[4]) >= SUPPORT and part[1] == _fixed(" ".join(html.unescape(c).split())):
                    (headlines if node.tag in HEADLINES else out).add(_place(node, k))
            elif _is_menu(part):
                out.add(_place(node, k))
            elif not c.dropped:
                _template(c, part, out, headlines)


def _place(node: Node, k: int) -> int:
    return id(node) * 1_000_003 + k


def _named(wrapper: list) -> int:
    """The text of the largest article or main element in a wrapper."""
    own = wrapper[4] - wrapper[5] if wrapper[0].split()[0] in ("article", "main") else 0
    return max([own, *(_named(c) for c in wrapper[1] if c[0] is not None)])


def main_path(wrapper: list) -> list[str]:
    """Labels from below the root down to the element that holds the main text."""
    path: list[str] = []
    while True:
        whole = wrapper[4] - wrapper[5]
        parts = [c for c in wrapper[1] if c[0] is not None]
        best = max(parts, key=lambda c: (_named(c) * 2 >= whole > 0, c[4] - c[5]), default=None)
        if best is None or best[0].split()[0] not in CONTAINERS or best[4] <= best[5]:
            return path
        beside = [c for c in parts if c is not best and c[4] > 0 and c[0].split()[0] not in CONTAINERS and not _is_menu(c)]
        if _named(best) * 2 < whole and (beside or best[3] or 100 * (best[4] - best[5]) < MOST * whole):
            return path
        path.append(best[0])
        if best[3] or best[0].split()[0] == "article":
            return path
        wrapper = best


def _follow(root: Node, path: list[str]) -> list[Node]:
    nodes = [root]
    for label in path:
        nodes = [c for n in nodes for c in n.children if isinstance(c, Node) and c.label == label and not c.dropped]
    return nodes


def _find(node: Node, tag: str, out: list[Node]) -> list[Node]:
    for c in node.children:
        if isinstance(c, Node) and not c.dropped:
            out.append(c) if c.tag == tag else _find(c, tag, out)
    return out


def _blocks(node: Node, template: set[int], headlines: set[int], held: list[tuple[str, bool]], out: list[tuple[str, bool]]) -> None:
    """Texts of blocks, and whether each is a fixed headline only."""

    def flush() -> None:
        text = " ".join("".join(t for t, _ in held).split())
        if text:
            out.append((text, all(fixed for t, fixed in held if t.strip())))
        held.clear()

    for k, c in enumerate(node.children):
        place = _place(node, k)
        if place in template:
            continue
        if isinstance(c, str):
            held.append((html.unescape(c), place in headlines))
        elif c.tag == "br" or c.tag in ("wbr", "img", "input"):
            held.append((" " if c.tag == "br" else "", False))
        elif not c.dropped:
            flush()
            _blocks(c, template, headlines, held, out)
            flush()
    if node.tag == "#root":
        flush()


def extract(page: str | None, wrapper: list | None, labels: frozenset | set | None = None, path: list[str] | None = None) -> str:
    """The main text of a page; path: what main_path says of the wrapper, where it is known already."""
    if not page:
        return ""
    root = parse(page, labels)
    template: set[int] = set()
    headlines: set[int] = set()
    regions: list[Node] = []
    if wrapper is not None and wrapper[0] == root.label:
        if len(wrapper[6]) >= SUPPORT:
            regions = _follow(root, main_path(wrapper) if path is None else path)
            _template(root, wrapper, template, headlines)
    found = regions or _find(root, "article", []) or _find(root, "main", []) or [root]
    kept = _text(found, template, headlines)
    if template or headlines:  # pages that are copies of one another have no template that could be told from their text
        whole = _text(found, set(), set())
        return whole if len(kept) * 100 < LEAST * len(whole) else kept
    return kept


def _text(regions: list[Node], template: set[int], headlines: set[int]) -> str:
    out: list[tuple[str, bool]] = []
    for a in regions:
        held: list[tuple[str, bool]] = []
        _blocks(a, template, headlines, held, out)
        text = " ".join("".join(t for t, _ in held).split())
        if text:
            out.append((text, all(fixed for t, fixed in held if t.strip())))
    while out and out[-1][1]:  # a fixed headline with nothing below it
        out.pop()
    return "\n".join(t for t, _ in out)


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _page_labels(page: str) -> set[str]:
    """Labels of a page's tags that are more than the tag; some may lie in scripts and the like, where they do no harm."""
    lower = page.lower()
    if "class" not in lower and "id" not in lower:
        return set()
    opened = ((name.lower(), _attributes(raw)) for _, _, name, closes, raw in _tags(page) if name is not None and not closes and "=" in raw)
    return {_label(tag, attributes) for tag, attributes in opened if attributes.get("class") or attributes.get("id")}


def _json(wrapper: list) -> str:
    return json.dumps(wrapper, ensure_ascii=False, separators=(",", ":"))


def hosts(pages: DataFrame) -> DataFrame:
    """host, n (different pages), labels (those that count). pages: host, html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, marks, labels = [], [], []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if page:
                    found = sorted({"", *_page_labels(page)})  # the empty label stands for the page
                    own += [host] * len(found)
                    marks += [_mark(page)] * len(found)
                    labels += found
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(marks, pa.int64()), pa.array(labels, pa.string())], names=["host", "mark", "label"])

    counted = pages.mapInArrow(run, "host string, mark long, label string").groupBy("host", "label").agg(F.count_distinct("mark").alias("n"))
    held = Scratch(pages.sparkSession, "html-labels").save(counted, "labels")
    sizes = held.where("label = ''").select("host", "n")
    often = held.where("label <> ''").join(sizes.withColumnRenamed("n", "of"), "host").where((F.col("n") >= SUPPORT) & (F.col("n") * RARE >= F.col("of")))
    kept = often.groupBy("host").agg(F.array_sort(F.collect_list("label")).alias("labels"))  # at most RARE times what a page has
    return sizes.join(kept, "host", "left").select("host", "n", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))


def _lookup(side: DataFrame, size) -> DataFrame:
    """A stored side of hosts, to be broadcast if all of it is small."""
    return F.broadcast(side) if (side.agg(F.sum(size)).first()[0] or 0) <= MAX_WRAPPER_BYTES else side


def _labels_size():
    return F.aggregate("labels", F.lit(64).cast("long"), lambda acc, x: acc + F.octet_length(x))


def wrappers(pages: DataFrame, known: DataFrame) -> DataFrame:
    """host and wrapper (JSON) of all hosts with SUPPORT different pages or more; pages: host, html; known: as ``hosts`` gives it, stored."""
    schema = "host string, bits int, bucket long, mark long, wrapper string"
    shapes = "host string, bits int, bucket long, wrapper string"

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                page, bits = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                marks = [_mark(p) for p in page]
                made = [_json(_shape(parse(p, set(labels)), m)) for p, m, labels in zip(page, marks, batch.column(3).to_pylist())]
                columns = [batch.column(0), pa.array(bits, pa.int32()), pa.array([m >> 63 - b for m, b in zip(marks, bits)], pa.int64()), pa.array(marks, pa.int64()), pa.array(made, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["host", "bits", "bucket", "mark", "wrapper"])

    def fold(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {}
        for batch in batches:
            found.update(zip(batch.column("mark").to_pylist(), batch.column("wrapper").to_pylist()))  # one of each page
        merged = None
        for _, raw in sorted(found.items()):
            own = json.loads(raw)
            merged = own if merged is None else _merge(merged, own)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int32()), pa.array([key[2].as_py()], pa.int64()), pa.array([_json(merged)], pa.string())], names=["host", "bits", "bucket", "wrapper"])

    scratch = Scratch(pages.sparkSession, "html-wrappers")
    bits = F.greatest(F.ceil(F.log2(F.col("n") / BUCKET)), F.lit(0)).cast("int")
    asked = known.where(F.col("n") >= SUPPORT)
    side = _lookup(asked, _labels_size()).select(F.col("host").alias("_host"), bits.alias("bits"), "labels")
    joined = pages.where("html <> ''").join(side, F.col("host") == F.col("_host")).select("host", "html", "bits", "labels")
    held = scratch.save(joined.mapInArrow(shape, schema).groupBy("host", "bits", "bucket").applyInArrow(fold, shapes), "round0")
    left = asked.agg(F.max(bits)).first()[0] or 0
    rounds = 0
    while left > 0:  # 64 neighbours to one
        rounds, left = rounds + 1, left - ROUND_BITS
        step = F.least("bits", F.lit(ROUND_BITS))
        next_up = held.select("host", (F.col("bits") - step).alias("bits"), F.call_function("shiftright", F.col("bucket"), step).alias("bucket"), F.col("bucket").alias("mark"), "wrapper")
        held = scratch.save(next_up.groupBy("host", "bits", "bucket").applyInArrow(fold, shapes), f"round{rounds}")
    return held.select("host", "wrapper")


def extract_text(pages: DataFrame) -> DataFrame:
    """pages with text and n_chars; columns of these names are replaced."""
    scratch = Scratch(pages.sparkSession, "html-text")
    plain = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    known = scratch.save(hosts(plain), "hosts")
    told = scratch.save(known.where(F.col("n") >= SUPPORT).join(wrappers(plain, known), "host", "left").select(F.col("host").alias("_host"), "labels", F.col("wrapper").alias("_wrapper")), "wrappers")
    side = _lookup(told, _labels_size() + F.octet_length("_wrapper"))
    base = pages.drop("text", "n_chars")
    names = [f"_c{k}" for k in range(len(base.columns))]  # callers' names may be anything
    joined = base.toDF(*names).join(side.select("_host", F.to_json("labels").alias("_labels"), "_wrapper"), host_of(F.col(names[base.columns.index("url")])) == F.col("_host"), "left").drop("_host")
    place = base.columns.index("html")
    out = StructType([*(StructField(n, f.dataType) for n, f in zip(names, base.schema.fields)), StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, tuple[list, set, list]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = []
                for page, labels, raw in zip(batch.column(place).to_pylist(), batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()):
                    if raw is not None and raw not in parsed:
                        if len(parsed) > 256:
                            parsed.clear()
                        own = json.loads(raw)
                        parsed[raw] = own, set(json.loads(labels)), main_path(own)
                    texts.append(extract(page, *(parsed[raw] if raw is not None else (None,))))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.string()), pa.array([*map(len, texts)], pa.int64())], names=[*names, "text", "n_chars"])

    return joined.mapInArrow(run, out).toDF(*base.columns, "text", "n_chars")


def report(pages: DataFrame) -> DataFrame:
    return extract_text(pages).select("page_id", "url", "text", "n_chars")
