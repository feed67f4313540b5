"""Main text of web pages by wrapper induction: same-host pages are aligned by simple tree matching.

Each task grows one wrapper a host: a page's folded block tree (see page_tree) is matched with the wrapper,
matched nodes are merged, the rest is put in at its place. The wrappers of all tasks are merged in the same
way, first within shares of a host, then across them, so every page of a host takes part. A wrapper's flow
slot knows on how many pages it stands, how much text and links it held, and which of its texts stood on
every page (constant nodes); what varies is content. On a page, the walk from the root towards the node
whose slots vary most (an article or main element if the page has one) finds the main text; below it go
menus, headers (but for their headings), footers, sidebars, notices, adverts, forms and comments as their
elements, roles or class words name them, slots that are nearly all links, and constant texts.

A text counts as constant only where its slot had at least DISTINCT different contents on the host's pages
and the constant texts are at most CONSTANT_SHARE of the slot, a whole slot only where it is the same on at
least DISTINCT pages and such slots are at most CONSTANT_SHARE of what is kept: pages of a host that are
copies of one another agree everywhere without being a template.

Defined results: null html is empty and gives an empty text; a null or unusable url puts the page in no
host, so it is its own wrapper; repeated rows give repeated results and count as one content; an empty table
gives no rows; further input columns are ignored. Line breaks inside a block are white space; nothing is cut.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import page_tree
from .common import Scratch, read_table

HOST = r"^\s*[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:\s]+)"
DISTINCT, CONSTANT_SHARE, DOMINANT = 8, 0.3, 0.6
#: wrappers that a task holds at once, and shares of a host
HELD_NODES, SHARES, HOT = 100_000, 64, 1 / 500


class Place:
    """A wrapper's node: how many pages have it, and for flow slots what stood there."""

    __slots__ = ("label", "tag", "verdict", "kids", "n", "chars", "links", "heads", "constant", "sketch")

    def __init__(self, label: str, tag: str, verdict: str):
        self.label, self.tag, self.verdict = label, tag, verdict
        self.kids: list[Place] = []
        self.n = self.chars = self.links = self.heads = 0
        #: hash and length of the texts that stood on every page; the least hashes of the slot's contents
        self.constant: dict[int, int] | None = None
        self.sketch: list[int] = []

    def count(self, n: int, chars: int, links: int, heads: int, constant: dict[int, int], sketch: list[int]) -> None:
        self.n, self.chars, self.links, self.heads = self.n + n, self.chars + chars, self.links + links, self.heads + heads
        self.constant = constant if self.constant is None else {k: v for k, v in self.constant.items() if k in constant}
        self.sketch = sorted({*self.sketch, *sketch})[:DISTINCT]

    def dump(self) -> list:
        return [self.label, self.tag, self.verdict, self.n, self.chars, self.links, self.heads, [[k, v] for k, v in (self.constant or {}).items()], self.sketch, [k.dump() for k in self.kids]]

    @staticmethod
    def load(x: list) -> Place:
        out = Place(x[0], x[1], x[2])
        out.n, out.chars, out.links, out.heads, out.constant, out.sketch = x[3], x[4], x[5], x[6], dict(map(tuple, x[7])), x[8]
        out.kids = [Place.load(k) for k in x[9]]
        return out


def put_in(place: Place, other, new, memo: dict, to: dict) -> None:
    """Aligns another tree's children with a place's; to: the place of each of that tree's nodes, by id. new(node) makes a place of an unmatched one."""
    to[id(other)] = place
    pairs = dict(page_tree.match(other, place, memo)[1])
    kids, done = [], 0
    for i, kid in enumerate(other.kids):
        if i in pairs:
            kids += place.kids[done : pairs[i] + 1]
            done = pairs[i] + 1
            put_in(kids[-1], kid, new, memo, to)
        else:
            kids.append(fresh := new(kid))
            put_in(fresh, kid, new, memo, to)
    place.kids = kids + place.kids[done:]


class Wrapper:
    """The template of one host's pages."""

    def __init__(self, top: Place | None = None):
        self.top, self.known = top or Place("html", "html", ""), {}
        self.chosen: dict = {}

    def places(self, page: page_tree.Slot, grow: bool) -> list[Place]:
        """The place of each of the page's slots (parents first); pages of one structure are matched once."""
        key = f"{page.label}{page.sign}"
        if key not in self.known:
            to: dict = {}
            put_in(self.top if grow else Place.load(self.top.dump()), page, lambda s: Place(s.label, s.tag, s.verdict), {}, to)
            self.known[key] = [to[id(s)] for s in page_tree.slots_of(page)]
        return self.known[key]

    def learn(self, page: page_tree.Slot, blocks: list) -> None:
        places = self.places(page, True)
        for slot, place in zip(page_tree.slots_of(page), places):
            if slot.tag:
                place.n += 1
                continue
            texts = [(page_tree.hash_text(blocks[b][0]), len(blocks[b][0]), blocks[b][1]) for b in slot.blocks]
            place.count(1, sum(x[1] for x in texts), sum(x[2] for x in texts), sum(blocks[b][2] for b in slot.blocks), {h: n for h, n, _ in texts}, [page_tree.hash_text(str([h for h, _, _ in texts]))])

    def merge(self, other: Place) -> None:
        to: dict = {}
        put_in(self.top, other, lambda p: Place(p.label, p.tag, p.verdict), {}, to)
        for p in page_tree.slots_of(other):
            if p.tag:
                to[id(p)].n += p.n
            else:
                to[id(p)].count(p.n, p.chars, p.links, p.heads, p.constant or {}, p.sketch)
        self.known.clear()

    def content(self, places: list[Place]) -> dict[int, tuple[str, frozenset]]:
        """Of a page with these places: the flow slots of its main text, "" or "h" (headings only), and the constant texts to leave out."""
        here, weights = {id(p) for p in places}, {}

        def constants(p: Place) -> frozenset:
            small = len(p.sketch) >= DISTINCT and sum(p.constant.values()) * p.n <= CONSTANT_SHARE * p.chars
            return frozenset(p.constant) if small else frozenset()

        def weigh(p: Place) -> float:
            if p.verdict:
                w = 0.0
            elif p.tag:
                w = sum(weigh(k) for k in p.kids if id(k) in here)
            elif p.links > page_tree.LINK_SHARE * p.chars:
                w = 0.0
            else:
                w = max(0.0, (p.chars - p.links) / max(p.n, 1) - sum(p.constant[c] for c in constants(p)))
            weights[id(p)] = w
            return w

        def marked(p: Place) -> bool:
            return weights.get(id(p), 0) > 0 and (p.tag in ("article", "main") or any(marked(k) for k in p.kids if id(k) in here))

        weigh(self.top)
        root = self.top
        while root.tag != "article":
            kids = [k for k in root.kids if k.tag and weights.get(id(k), 0) > 0]
            best = max((k for k in kids if marked(k)), key=lambda k: weights[id(k)], default=None)
            if best is None:
                best = max(kids, key=lambda k: weights[id(k)], default=None)
                if best is None or weights[id(best)] < DOMINANT * weights[id(root)]:
                    break
            # a heading belongs to what follows it
            if any(not k.tag and 2 * k.heads > k.n and weights.get(id(k), 0) > 0 for k in root.kids):
                break
            root = best
        out: dict[int, tuple[str, frozenset]] = {}
        todo, kept = [(k, "") for k in root.kids], []
        while todo:
            p, how = todo.pop()
            if id(p) not in here or p.verdict == "x":
                continue
            if p.tag:
                todo += [(k, "h" if p.verdict == "h" else how) for k in p.kids]
            elif p.links <= page_tree.LINK_SHARE * p.chars:
                out[id(p)] = (how, constants(p))
                kept.append(p)
        # places that hold the same on every page, if they are the lesser part of the page
        same = [p for p in kept if len(p.sketch) == 1 and p.n >= DISTINCT]
        if sum(p.chars / p.n for p in same) <= CONSTANT_SHARE * sum(p.chars / p.n for p in kept):
            for p in same:
                del out[id(p)]
        return out

    def text(self, page: page_tree.Slot, blocks: list) -> str:
        key = f"{page.label}{page.sign}"
        if key not in self.chosen:
            if key not in self.known:
                # a page that took part in the wrapper finds all its places there
                self.places(page, True)
            self.chosen[key] = self.content(self.known[key])
        chosen = self.chosen[key]
        at = {id(s): p for s, p in zip(page_tree.slots_of(page), self.known[key])}
        lines = []
        for text, _, heading, slot in blocks:
            how, constant = chosen.get(id(at[id(slot)]), ("x", frozenset()))
            if how == "x" or how == "h" and not heading or constant and page_tree.hash_text(text) in constant:
                continue
            lines.append(text)
        return "\n".join(lines)


def with_host(pages: DataFrame) -> DataFrame:
    """page_id, url, html and host (empty without a usable url)."""
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)).alias("host"))


WRAPPER_TYPES = pa.schema([("host", pa.string()), ("share", pa.int32()), ("n", pa.int64()), ("wrapper", pa.string())])


def wrapper_rows(wrappers: dict[str, Wrapper], share: int) -> pa.RecordBatch:
    rows = [{"host": h, "share": share, "n": w.top.n, "wrapper": json.dumps(w.top.dump(), separators=(",", ":"))} for h, w in wrappers.items()]
    return pa.RecordBatch.from_pylist(rows, WRAPPER_TYPES)


def induce(hosted: DataFrame) -> DataFrame:
    """host, n, wrapper: one row a host. Pages without a host take no part."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, size, share = {}, 0, TaskContext.get().partitionId() % SHARES
        for b in batches:
            for host, html in zip(b.column(0).to_pylist(), b.column(1)):
                page, blocks = page_tree.fold(page_tree.parse(html.as_py()))
                if host not in held:
                    held[host] = Wrapper()
                    size += 20 + len(blocks)
                held[host].learn(page, blocks)
                if size > HELD_NODES:
                    yield wrapper_rows(held, share)
                    held, size = {}, 0
        if held:
            yield wrapper_rows(held, share)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host = wrapper = None
        for b in batches:
            for h, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                top = Place.load(json.loads(w))
                if h == host:
                    wrapper.merge(top)
                    continue
                if wrapper:
                    yield wrapper_rows({host: wrapper}, 0)
                host, wrapper = h, Wrapper(top)
        if wrapper:
            yield wrapper_rows({host: wrapper}, 0)

    schema = "host string, share int, n long, wrapper string"
    parts = hosted.where("host <> ''").select("host", "html").mapInArrow(grow, schema)
    for keys in (("host", "share"), ("host",)):
        parts = parts.repartition(*keys).sortWithinPartitions(*keys, "wrapper").select("host", "wrapper").mapInArrow(merge, schema)
    return parts.select("host", "n", "wrapper")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page. The wrappers are written to the shared folder."""
    hosted, spark = with_host(pages), pages.sparkSession
    wrappers = Scratch(spark, "wrappers").write(induce(hosted), "wrappers")
    total = wrappers.agg(F.sum("n")).head()[0] or 0
    # a host with a large part of all pages is dealt to shares; there are at most 1 / HOT of them
    hot = [r.host for r in wrappers.where(F.col("n") > total * HOT).select("host").collect()]
    dealt = F.col("host").isin(hot) | (F.col("host") == "")
    rows = hosted.withColumn("share", F.when(dealt, F.pmod(F.xxhash64("page_id", "html"), F.lit(SHARES)).cast("int")).otherwise(0))
    heads = wrappers.withColumn("share", F.explode(F.when(F.col("host").isin(hot), F.sequence(F.lit(0), F.lit(SHARES - 1))).otherwise(F.array(F.lit(0)))))
    both = rows.withColumn("wrapper", F.lit(None).cast("string")).unionByName(heads.select(F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "host", "share", "wrapper"))
    met = both.repartition("host", "share").sortWithinPartitions("host", "share", F.col("wrapper").desc_nulls_last())
    types = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrapper = Wrapper()
        for b in batches:
            out: list = []
            for page_id, url, html, host, w in zip(*(c if i == 2 else c.to_pylist() for i, c in enumerate(b.columns))):
                if w is not None:
                    wrapper = Wrapper(Place.load(json.loads(w)))
                    continue
                page, blocks = page_tree.fold(page_tree.parse(html.as_py()))
                if not host:
                    wrapper = Wrapper()
                    wrapper.learn(page, blocks)
                out.append((page_id, url, wrapper.text(page, blocks)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), types)], schema=types)

    return met.select("page_id", "url", "html", "host", "wrapper").mapInArrow(run, "page_id long, url string, text string")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = extract(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op11_html_extraction": op11_html_extraction}
SQL: dict[str, str] = {}
