"""Pages as folded token streams: a page's blocks of text, and the regular expression of its own structure.

A page becomes a tree of its block elements. An element's token is its name with its class, id and role, digits left out; text between
block elements is one block, one token ``#``, whatever inline elements it has. Equal neighbours fold into a repeated
item and repeated groups into a repeated group, their contents aligned, so a page with nine paragraphs has the
expression of a page with two. What tells a block from another is then its slot, the place of its text in the
folded expression.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Sequence
from functools import lru_cache

#: Elements that begin and end a block; void elements; elements whose content is not markup.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav noscript ol optgroup
    option p pre search section select summary table tbody td template tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea xmp title".split())
#: Inline elements that never hold an article's text.
MUTED = frozenset("audio button canvas datalist map object rp svg video".split())
#: What an opening element closes first, and how far up that reaches.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "thead": ({"tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody"}, {"table"}), "option": ({"option"}, {"select"}), "optgroup": ({"optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: Elements nested deeper than this are read as if they were not there; their text stays.
DEEPEST = 60
#: Cells of an alignment table; longer lists are aligned by looking ahead for the next common token.
CELLS = 40_000
LONGEST_GROUP = 6

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/<>]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>"""
                    r"""|<(/?)([A-Za-z][^\s/<>]*)([^<>]*)>|<[!?][^<>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


class Node:
    """An item of an expression: an element, a text (``#``) or a group (``()``)."""

    __slots__ = ("label", "kids", "rep", "opt", "slots", "inner", "sig")

    def __init__(self, label: str, kids: list[Node] | None = None, rep: bool = False, opt: bool = False,
                 slots: list[int] | None = None):
        self.label, self.kids, self.rep, self.opt, self.slots = label, kids or [], rep, opt, slots or []
        self.sign(True)

    def sign(self, kids: bool = False) -> None:
        """The expression as text; nodes of one token and one inner text have one shape."""
        if kids:
            self.inner = " ".join([k.sig for k in self.kids])
        body = self.label if self.label != "()" else ""
        self.sig = f"{body}({self.inner})" if self.kids else body
        if self.opt or self.rep:
            self.sig += "?" * self.opt + "+" * self.rep


@lru_cache(maxsize=20_000)
def token_of(name: str, attributes: str) -> tuple[str, bool]:
    """An element's token, and whether it is hidden."""
    marks = set()
    for which, *values in _ATTRIBUTE.findall(attributes):
        for word in next((v for v in values if v), "").lower().split():
            mark = re.sub(r"[^\w-]|\d", "", word)
            if mark:
                marks.add(("@" if which.lower() in ("role", "itemprop") else ".") + mark)
    return name + "".join(sorted(marks)), bool(attributes) and bool(_HIDDEN.search(attributes))


def align(a: Sequence[Node], b: Sequence[Node]) -> list[tuple[int, int]]:
    """Pairs of places with equal tokens, rising in both lists: as many as there can be, in lists of ordinary length."""
    n, m = len(a), len(b)
    first = 0
    while first < n and first < m and a[first].label == b[first].label:
        first += 1
    pairs = [(i, i) for i in range(first)]
    if n * m <= CELLS:
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, first - 1, -1):
            row, below, label = best[i], best[i + 1], a[i].label
            for j in range(m - 1, first - 1, -1):
                row[j] = below[j + 1] + 1 if label == b[j].label else max(below[j], row[j + 1])
        i = j = first
        while i < n and j < m:
            if a[i].label == b[j].label:
                pairs.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
        return pairs
    places: dict[str, list[int]] = {}
    for j in range(m - 1, first - 1, -1):
        places.setdefault(b[j].label, []).append(j)
    j = first
    for i in range(first, n):  # the next place in b that has the token, unless that leaves out more of b than is left of a
        ahead = places.get(a[i].label, [])
        while ahead and ahead[-1] < j:
            ahead.pop()
        if ahead and ahead[-1] - j <= n - i:
            j = ahead.pop()
            pairs.append((i, j))
            j += 1
    return pairs


def _absorb(a: Node, b: Node) -> None:
    """Slots of ``b`` go to those of ``a``, a node of the same shape."""
    if a.slots is not b.slots:
        a.slots += b.slots
    for x, y in zip(a.kids, b.kids):
        _absorb(x, y)


def merge(a: Node, b: Node, repeated: bool = False) -> Node:
    """``a`` generalised so that it has ``b`` too. Both have the same token."""
    if a.inner == b.inner:
        _absorb(a, b)
    else:
        a.kids = merge_lists(a.kids, b.kids)
        a.slots += b.slots
    rep, opt = a.rep or b.rep or repeated, a.opt or b.opt
    if a.inner != b.inner or rep != a.rep or opt != a.opt:
        a.rep, a.opt = rep, opt
        a.sign(True)
    return a


def _flat(items: Sequence[Node], side: str) -> tuple[list[Node], dict[str, list[Node]]]:
    """Items with groups opened, and the members of every group."""
    out: list[Node] = []
    groups: dict[str, list[Node]] = {}
    for i, item in enumerate(items):
        if item.label == "()":
            members, _ = _flat(item.kids, "")
            if item.opt:
                for k in members:
                    k.opt = True
                    k.sign()
            groups[f"{side}{i}"] = members
            out += members
        else:
            out.append(item)
    return out, groups


def merge_lists(a: Sequence[Node], b: Sequence[Node]) -> list[Node]:
    """Two contents as one: what only one of them has becomes optional, groups of either stay groups."""
    (a, groups), (b, more) = _flat(a, "a"), _flat(b, "b")
    groups |= more
    became: dict[int, int] = {}
    out: list[Node] = []
    i = j = 0

    def alone(item: Node) -> None:
        became[id(item)] = len(out)
        item.opt = True
        item.sign()
        out.append(item)

    for x, y in [*align(a, b), (len(a), len(b))]:
        while i < x:
            alone(a[i])
            i += 1
        while j < y:
            alone(b[j])
            j += 1
        if x < len(a):
            became[id(a[x])] = became[id(b[y])] = len(out)
            out.append(merge(a[x], b[y]))
            i, j = x + 1, y + 1
    spans = sorted((min(at), max(at)) for at in ([became[id(m)] for m in g] for g in groups.values()) if at)
    return fold(_grouped(out, spans))


def _grouped(items: list[Node], spans: list[tuple[int, int]]) -> list[Node]:
    out: list[Node] = []
    at = 0
    joined: list[list[int]] = []
    for low, high in spans:
        if joined and low <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], high)
        else:
            joined.append([low, high])
    for low, high in joined:
        out += items[at:low]
        out.append(Node("()", items[low:high + 1], rep=True) if high > low else items[low])
        at = high + 1
    return out + items[at:]


def fold(items: Sequence[Node]) -> list[Node]:
    """Equal neighbours as one repeated item, then repeated runs of up to LONGEST_GROUP items as one group."""
    out: list[Node] = []
    for item in items:
        if out and out[-1].label == item.label != "()":
            opt = out[-1].opt and item.opt
            out[-1] = merge(out[-1], item, repeated=True)
            if out[-1].opt != opt:
                out[-1].opt = opt
                out[-1].sign()
        else:
            out.append(item)
    for size in range(2, LONGEST_GROUP + 1):
        if len(out) < 2 * size:
            break
        folded: list[Node] = []
        i = 0
        while i < len(out):
            run = out[i:i + size]
            labels = [x.label for x in run]
            j = i + size
            if len(run) == size and "()" not in labels:
                while [x.label for x in out[j:j + size]] == labels:
                    run = [merge(x, y) for x, y in zip(run, out[j:j + size])]
                    j += size
            if j > i + size:
                folded.append(Node("()", run, rep=True))
                i = j
            else:
                folded.append(out[i])
                i += 1
        out = folded
    return out


def read_page(page: str) -> tuple[Node, list[str], list[int]]:
    """A page's folded expression, its blocks in order, and how many characters of each are links.

    The expression's text nodes hold the numbers of their blocks.
    """
    texts: list[str] = []
    linked: list[int] = []
    stack: list[tuple[str, str, list[Node]]] = [("", "page", [])]
    muted: list[tuple[str, int]] = []
    run: list[str] = []
    in_link = link_chars = 0

    def flush() -> None:
        nonlocal link_chars, in_link
        if run:
            text = " ".join("".join(run).split())
            if text:
                stack[-1][2].append(Node("#", slots=[len(texts)]))
                texts.append(text)
                linked.append(min(link_chars, len(text)))
            run.clear()
        link_chars = in_link = 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            flush()
            _, label, kids = stack.pop()
            if kids:
                stack[-1][2].append(Node(label, fold(kids)))
        while muted and muted[-1][1] > len(stack):
            muted.pop()

    def say(raw: str) -> None:
        nonlocal link_chars
        if not muted and raw:
            raw = html.unescape(raw) if "&" in raw else raw
            run.append(raw)
            if in_link:
                link_chars += len(raw)

    at = 0
    while True:
        found = _TOKEN.search(page, at)
        say(page[at:found.start() if found else len(page)])
        if not found:
            break
        at = found.end()
        slash, name, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if not name:
            continue
        name = name.lower()
        if slash:
            if name in BLOCKS:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == name:
                        close(depth)
                        break
                else:
                    flush()
            elif name == "a":
                in_link = max(0, in_link - 1)
            elif muted and muted[-1][0] == name:
                muted.pop()
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "br" or name == "wbr":
            run.append(" " if name == "br" else "")
        elif name == "hr":
            close(len(stack) - 1 if stack[-1][0] == "p" else len(stack))
            flush()
        elif name in VOID:
            continue
        elif name in BLOCKS:
            flush()
            if stack[-1][0] == "p":
                close(len(stack) - 1)
            if name in CLOSES:
                those, up_to = CLOSES[name]
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] in up_to:
                        break
                    if stack[depth][0] in those:
                        close(depth)
                        break
            token, hidden = token_of(name, attributes)
            if len(stack) < DEEPEST:
                stack.append((name, token + "!" * hidden, []))
        elif name == "a":
            in_link += 1
        else:
            token, hidden = token_of(name, attributes)
            if not attributes.rstrip().endswith("/") and (name in MUTED or hidden or is_boilerplate(token)):
                muted.append((name, len(stack)))
    close(1)
    flush()
    return Node("page", fold(stack[0][2])), texts, linked


#: Elements, and words in classes, ids and roles, that stand for parts of a page other than its article.
ASIDE = frozenset("nav header footer aside form dialog menu noscript template select option optgroup fieldset legend head search".split())
ASIDE_WORDS = frozenset("""ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-share comment
    comments commentlist consent cookie cookies disclaimer disqus footer gdpr header login masthead menu menubar modal nav navbar navigation
    newsletter notice notices overlay pagination pager paywall popup promo promotion recommended related replies respond
    share sharing sidebar signup skip social sponsor sponsored subscribe teaser toolbar widget contentinfo complementary""".split())


@lru_cache(maxsize=20_000)
def is_boilerplate(token: str) -> bool:
    """Whether an element's token says that it is not part of the article."""
    name, *marks = re.split(r"[.@]", token.rstrip("!"))
    if name in ASIDE or token.endswith("!"):
        return True
    return name not in ("html", "body", "main") and any(w in ASIDE_WORDS for m in marks for w in re.split(r"[-_]+", m))


def write_expression(node: Node, number: Callable[[Node], int]) -> list:
    """A node as nested lists for JSON; ``number`` gives a text its slot number."""
    flags = node.rep + 2 * node.opt
    return [flags, number(node)] if node.label == "#" else [flags, node.label, [write_expression(k, number) for k in node.kids]]


def read_expression(of: list) -> Node:
    flags, what, *kids = of
    if isinstance(what, int):
        return Node("#", rep=bool(flags & 1), opt=bool(flags & 2), slots=[what])
    return Node(what, [read_expression(k) for k in kids[0]], rep=bool(flags & 1), opt=bool(flags & 2))


def texts_of(node: Node) -> list[Node]:
    """Text nodes in order."""
    if node.label == "#":
        return [node]
    return [t for k in node.kids for t in texts_of(k)]
