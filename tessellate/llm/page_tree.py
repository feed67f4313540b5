"""HTML to a folded block tree, and the simple tree matching that aligns two of them.

A page becomes a tree of block elements. Text blocks without blocks inside fold into one flow slot per
stretch of their parent; siblings of the same structure fold into one slot. So a tree has as many slots as
the page has different places, whatever its length."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

#: fixed values: the block elements of HTML, those that hold text, and those that never hold article text
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd address td th figcaption caption summary".split())
BLOCK_TAGS = TEXT_TAGS | frozenset("html body main article section div ul ol dl table thead tbody tfoot tr center details figure hgroup header footer nav aside form fieldset dialog menu hr".split())
DROPPED_TAGS = frozenset("head script style noscript template iframe object svg math canvas audio video textarea select button title nav footer aside form dialog menu".split())
RAW_TAGS = frozenset("script style textarea title iframe".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: words of class, id and role attributes that name a page's furniture
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner banners cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations sidebar widget widgets comment comments "
    "respond replies disqus breadcrumb breadcrumbs pagination pager menu nav navbar navigation footer masthead toolbar search complementary contentinfo dialog alertdialog".split()
)
#: after these words a furniture word only describes a container
MODIFIERS = frozenset("with has no without".split())
#: what an opening tag closes, and where the search for it ends
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"tbody", "thead"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"})}
P_SCOPE = frozenset({"td", "th", "caption", "table", "html", "button", "object"})
#: nesting beyond which elements no longer have a place of their own in the tree (browsers stop at 512)
DEEPEST = 256
#: share of links from which a stretch of text is a menu
LINK_SHARE = 0.8
#: a child joins a slot of its structure among the last so many of its parent
NEAR_SLOTS = 8

TOKEN = re.compile(
    r"""(<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|</?[a-zA-Z][^\s/<>]*(?:[^'"<>]++|"[^"<]*+"|'[^'<]*+'|"[^"]{0,2000}"|'[^']{0,2000}')*+>|</?[a-zA-Z][^<>]*(?:>|\Z)|<[!?/][^<>]*(?:>|\Z))""",
    re.S,
)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)(.*?)>?\Z", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    """A block element: its label for matching, its verdict ("" keep, "x" drop, "h" headings only) and its items (nodes, or (text, is_link))."""

    __slots__ = ("tag", "label", "verdict", "items")

    def __init__(self, tag: str, label: str = "", verdict: str = ""):
        self.tag, self.label, self.verdict, self.items = tag, label or tag, verdict, []


def named(tag: str, attributes: str) -> tuple[str, str]:
    """(label, verdict) of an element."""
    verdict, words = "x" if tag in DROPPED_TAGS else "h" if tag == "header" else "", []
    if "=" in attributes:
        for _, value in ATTRIBUTE.findall(attributes):
            for token in value.strip("\"'").split():
                parts = [w.lower() for w in WORD.findall(token)]
                if not any(p.isdigit() for p in parts):
                    words.append(token)
                before = [""] + parts
                if any(w in DROPPED_WORDS and b not in MODIFIERS for b, w in zip(before, parts)) and tag not in ("html", "body", "main", "article"):
                    verdict = "x"
                elif "header" in parts and not verdict and tag not in ("html", "body", "main", "article") and tag not in HEADINGS:
                    verdict = "h"
    return f"{tag}.{' '.join(sorted(set(words)))}" if words else tag, verdict


@lru_cache(8192)
def read_tag(token: str) -> tuple[bool, str, str, str, bool] | None:
    """(closes, tag, label, verdict, is empty) of a tag that builds the tree; None for comments and inline elements."""
    m = TAG.match(token)
    if not m:
        return None
    tag, attributes = m[2].lower(), m[3]
    if tag not in BLOCK_TAGS and tag not in DROPPED_TAGS and tag not in ("a", "br") or tag in ("html", "body"):
        return None
    if m[1] or tag in ("a", "br"):
        return bool(m[1]), tag, "", "", False
    label, verdict = named(tag, attributes)
    return False, tag, label, verdict, tag in VOID_TAGS or tag not in BLOCK_TAGS and attributes.endswith("/")


def close_before(stack: list[Node], tag: str) -> None:
    """What a new block element ends: an open paragraph, and items, cells or rows of its own kind."""
    closed, scope = {"p"}, P_SCOPE
    for _ in range(2):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in closed:
                del stack[k:]
                break
            if stack[k].tag in scope:
                break
        if tag not in CLOSES:
            return
        closed, scope = CLOSES[tag]


def parse(html: str) -> Node:
    """The page's block tree. Tags that are cut off, closed twice or never closed do no harm."""
    root = Node("html")
    stack, link, raw = [root], False, None
    items, parts = root.items, TOKEN.split(html)
    for text, token in zip(parts[::2], [*parts[1::2], None]):
        if raw:
            # everything up to the closing tag of a script or the like belongs to it
            if token and token[:2] == "</" and (found := read_tag(token)) and found[1] == raw:
                raw = None
            continue
        if text:
            items.append((text, link))
        if token is None:
            break
        if token[1] in "aA" and token[2:3] in (" ", ">", "\n", "\t", "\r", "\f"):
            link = True
            continue
        found = read_tag(token)
        if found is None:
            continue
        closes, tag, label, verdict, empty = found
        if tag == "br":
            items.append((" ", False))
        elif tag == "a":
            link = False
        elif closes:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    items, link = stack[-1].items, False
                    break
        else:
            if tag in BLOCK_TAGS:
                close_before(stack, tag)
            node = Node(tag, label, verdict)
            items = stack[-1].items
            items.append(node)
            if len(stack) > DEEPEST and not verdict:
                # deeper elements only break the text of the last one that counts
                node.items = items
            if tag in RAW_TAGS and not empty:
                raw = tag
            elif not empty:
                stack.append(node)
                items, link = node.items, False
    return root


class Slot:
    """A place in a folded tree. A flow slot (tag "") holds the text blocks of its stretch, in order."""

    __slots__ = ("tag", "label", "verdict", "kids", "sign", "blocks", "index")

    def __init__(self, tag: str, label: str, verdict: str):
        self.tag, self.label, self.verdict = tag, label, verdict
        self.kids, self.sign, self.blocks, self.index = [], "", [], -1


def clean(text: str) -> str:
    return " ".join((entities.unescape(text) if "&" in text else text).split())


def words_of(items: list) -> tuple[str, int]:
    """The text with its references decoded and its white space as single spaces, and how many characters of it are links."""
    if len(items) == 1:
        text = clean(items[0][0])
        return text, len(text) if items[0][1] else 0
    text = clean("".join(t for t, _ in items))
    links = sum(len(clean(t)) for t, link in items if link)
    return text, min(links, len(text))


def fold(page: Node) -> tuple[Slot, list[tuple[str, int, bool, Slot]]]:
    """The folded tree, and the page's text blocks in page order: (text, characters of links, is a heading, flow slot)."""
    blocks: list = []

    def add(slots: list[Slot], slot: Slot) -> Slot:
        """The slot among the parent's last ones that has the same structure, or the new one."""
        for old in slots[-NEAR_SLOTS:]:
            if old.label == slot.label and old.sign == slot.sign:
                join(old, slot)
                return old
        slots.append(slot)
        return slot

    def join(old: Slot, new: Slot) -> None:
        for b in new.blocks:
            blocks[b][3] = old
        old.blocks += new.blocks
        for a, b in zip(old.kids, new.kids):
            join(a, b)

    def text_block(slots: list[Slot], items: list, heading: bool) -> None:
        text, links = words_of(items)
        if not text:
            return
        slot = next((k for k in slots[-NEAR_SLOTS:] if not k.tag), None)
        if slot is None:
            slots.append(slot := Slot("", "", ""))
        slot.blocks.append(len(blocks))
        blocks.append([text, links, heading, slot])

    def describe(flow: Slot) -> None:
        """Stretches of links match only their like; a heading tells two stretches of one page apart."""
        texts = [blocks[b] for b in flow.blocks]
        flow.label = "a" if sum(t[1] for t in texts) > LINK_SHARE * sum(len(t[0]) for t in texts) else "t"
        flow.sign = "h" if any(t[2] for t in texts) else ""

    # depth first without recursion: (node, its slot, the next item, loose text)
    top = Slot(page.tag, page.label, page.verdict)
    open_ = [(page, top, iter(page.items), [])]
    while open_:
        node, slot, rest, loose = open_[-1]
        for item in rest:
            if isinstance(item, tuple):
                loose.append(item)
                continue
            deeper = item.items is not node.items
            if loose:
                text_block(slot.kids, loose, node.tag in HEADINGS)
                loose.clear()
            if not deeper:
                continue
            if (item.tag in TEXT_TAGS or item.label in ("div", "section", "center")) and not item.verdict and all(isinstance(x, tuple) for x in item.items):
                text_block(slot.kids, item.items, item.tag in HEADINGS)
                continue
            open_.append((item, Slot(item.tag, item.label, item.verdict), iter(item.items), []))
            break
        else:
            if loose:
                text_block(slot.kids, loose, node.tag in HEADINGS)
            for k in slot.kids:
                if not k.tag:
                    describe(k)
            slot.sign = f"({','.join(f'{k.label}{k.sign}' for k in slot.kids)})"
            if len(slot.sign) > 64:
                slot.sign = f"#{hash_text(slot.sign)}"
            open_.pop()
            if open_ and slot.kids:
                add(open_[-1][1].kids, slot)
    return top, [tuple(b) for b in blocks]


def hash_text(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode())


def match(a: Slot, b, memo: dict) -> tuple[int, list]:
    """Simple tree matching: the most pairs of equally labelled nodes that keep order and parents, and the pairs of children that give it."""
    key = (id(a), id(b))
    if key not in memo:
        m, n = len(a.kids), len(b.kids)
        best = [[0] * (n + 1) for _ in range(m + 1)]
        for i in range(m):
            for j in range(n):
                same = a.kids[i].label == b.kids[j].label
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + match(a.kids[i], b.kids[j], memo)[0] if same else 0)
        pairs, i, j = [], m, n
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
        memo[key] = (best[m][n] + 1, pairs[::-1])
    return memo[key]


def slots_of(top) -> Iterator:
    """A tree's slots, parents first."""
    todo = [top]
    while todo:
        slot = todo.pop()
        yield slot
        todo += slot.kids[::-1]
