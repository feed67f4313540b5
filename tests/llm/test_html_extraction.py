"""Templates of several hosts around known articles, odd markup, and simple tree matching against all alignments."""

import html
import itertools
import random
from types import SimpleNamespace

from tessellate.llm import html_extraction as hx
from tessellate.llm import page_tree

SCHEMA = "page_id long, url string, html string"


def sentence(rng, n=12):
    return (" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)) + ".").capitalize()


def article(rng):
    return [sentence(rng, 4)] + [sentence(rng, rng.randint(5, 60)) for _ in range(rng.randint(2, 7))]


def plain(rng, blocks):
    """Menus, adverts and footers that vary, as elements and class words name them."""
    body = "".join(f"<p>{html.escape(b)}" for b in blocks[1:])
    links = "".join(f'<li><a href="/{i}">{sentence(rng, 1)}</a>' for i in range(rng.randint(2, 9)))
    return f"""<!DOCTYPE html><html><head><title>x</title><style>p > a{{}}</style></head><BODY class="with-sidebar"><header><h1>Site</h1><p>{sentence(rng)}</header>
<nav><ul>{links}</ul></nav><div class="cookie-notice">{sentence(rng, 30)}</div><!-- <p>no --><article id="post-{rng.randint(1, 99)}"><header><h1>{html.escape(blocks[0])}</h1><p>By {sentence(rng, 2)}</p></header>{body}
<div class="ad-box"><p>{sentence(rng, 30)}</div></article><section id="comments">{"".join(f"<p>{sentence(rng, 40)}</p>" for _ in range(rng.randint(0, 9)))}</section>
<form><label>{sentence(rng)}</label><input value="<p>"></form><aside><p>{sentence(rng, 30)}</aside><script>if (a < b) document.write("</p><p>no")</script><footer>{sentence(rng)}</footer></html>"""


def bare(rng, blocks):
    """Only div elements without names: what varies most is the article; a constant notice stands among its paragraphs."""
    links = "".join(f'<div><a href="/{i}">{sentence(rng, 2)}</a></div>' for i in range(8))
    inner = "".join(f"<div>{html.escape(b)}</div>" if i else f"<h2>{html.escape(b)}</h2>" for i, b in enumerate(blocks))
    return f"<div><div>{links}</div></div><div><div><span>{sentence(rng, 3)}</span></div></div><div id='c{rng.randint(1, 99)}'><div>Read more with our newsletter, every week.</div>{inner}</div><div><p><b>About us, imprint, terms</b></div>"


def pages_of(rng, host, build, n, first):
    rows, want = [], {}
    for i in range(n):
        blocks = article(rng)
        rows.append((first + i, f"http://{host}/{i}", build(rng, blocks)))
        want[first + i] = "\n".join(blocks)
    return rows, want


def test_templates_of_hosts(spark, tmp_path):
    rng, rows, want = random.Random(3), [], {}
    for host, build, n in (("a.org", plain, 150), ("User@B.com:80", bare, 40), ("one.net", plain, 1), ("c.org", plain, 5)):
        more, truth = pages_of(rng, host, build, n, len(rows))
        rows, want = rows + more, want | truth
    # two hosts of copies: everything agrees, and yet nothing is a template
    copy = article(rng)
    for i in range(30):
        rows.append((1000 + i, f"https://copies.org/{i}", plain(rng, copy)))
        want[1000 + i] = "\n".join(copy)
    rows.append(rows[0])
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", host string, share int").repartition(6)
    table.write.parquet(f"{tmp_path}/pages.parquet")
    got = hx.op11_html_extraction(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_odd_pages(spark):
    long = "word " * 300_000
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    rows = [
        (1, None, None), (2, "", ""), (3, "not a url", "no markup at all"), (None, None, "<p>a&nbsp;&amp;\n b<br>c</p></p></div>&lt;d&gt; &#x1F642;"),
        (5, "http://long", f"<p>{long}<p>{long}"), (6, "http://deep", deep), (7, "http://cut", "<p>text <a href='x"), (8, "http://cut", "<script>var a = '<p>'"),
        (9, "http://q", "<p title=\"a > b\">q</p>" + "<x '" * 20_000), (10, "http://t", "<table><tr><td>a<td>b<tr><td>c</table>1 < 2"), (11, "http://h", "<nav><p>only a menu</nav>"),
    ]
    got = {r.page_id: r.text for r in hx.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got.pop(5) == f"{long.strip()}\n{long.strip()}"
    assert got.pop(9).startswith("q")
    assert got == {1: "", 2: "", 3: "no markup at all", None: "a & b c\n<d> 🙂", 6: "deep text", 7: "text", 8: "", 10: "a\nb\nc\n1 < 2", 11: ""}
    assert hx.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_common_passages_stay(spark):
    """A line that all pages of a small host share is no template; on many different pages it is."""
    rng, rows = random.Random(1), []
    for host, n in (("few.org", 4), ("many.org", 12)):
        rows += [(len(rows) + i, f"http://{host}/{i}", f"<article><p>{sentence(rng, 40)}<p>Released under a licence.</article>") for i in range(n)]
    got = [r.text.endswith("licence.") for r in sorted(hx.extract(spark.createDataFrame(rows, SCHEMA)).collect())]
    assert got == [True] * 4 + [False] * 12


def tree(rng, depth):
    return SimpleNamespace(label=rng.choice("xyz"), kids=[tree(rng, depth - 1) for _ in range(rng.randint(0, 3))] if depth else [])


def best_alignment(a, b):
    m, n = len(a.kids), len(b.kids)
    best = 0
    for k in range(min(m, n) + 1):
        for left in itertools.combinations(range(m), k):
            for right in itertools.combinations(range(n), k):
                if all(a.kids[i].label == b.kids[j].label for i, j in zip(left, right)):
                    best = max(best, sum(best_alignment(a.kids[i], b.kids[j]) for i, j in zip(left, right)))
    return best + 1


def test_matching_equals_all_alignments():
    rng = random.Random(2)
    for _ in range(200):
        a, b = tree(rng, 3), tree(rng, 3)
        size, pairs = page_tree.match(a, b, memo := {})
        assert size == best_alignment(a, b)
        assert size == 1 + sum(page_tree.match(a.kids[i], b.kids[j], memo)[0] for i, j in pairs)
