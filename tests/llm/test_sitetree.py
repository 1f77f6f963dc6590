import collections
import math
import random

import pytest

from txloom.llm import sitetree

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
SCHEMA = "page_id long, url string, html string"


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in sitetree.extract(spark.createDataFrame(rows, SCHEMA)).collect()}


def kept(html):
    return "\n".join(b["text"] for b in sitetree.judged(sitetree.Page(html))[1])


def plain_importance(rows):
    """Importance of (host, path) by loops over whole pages."""
    sites = collections.defaultdict(dict)
    for _, url, html in rows:
        nodes, _ = sitetree.judged(sitetree.Page(html or ""))
        sites[sitetree.host(url)][repr(nodes)] = nodes
    out = {}
    for host, pages in sites.items():
        for path in {n[0] for nodes in pages.values() for n in nodes}:
            mine = [n for nodes in pages.values() for n in nodes if n[0] == path]
            m, styles = len(mine), collections.Counter(n[2] for n in mine)
            if m < 2:
                out[host, path] = (m, 1.0)
                continue
            shown = -sum(c / m * math.log(c / m, m) for c in styles.values())
            said = collections.Counter((below[0], c) for nodes in pages.values() for below in nodes if path in below[1] for c in below[3])
            content = max(0.0, 1 - sum(math.log(c) for c in said.values()) / len(said) / math.log(m)) if said else 0.0
            w = sitetree.GAMMA ** len(styles)
            out[host, path] = (m, (1 - w) * shown + w * content)
    return out


def site(n, host="a.example", marked=False):
    """Pages of a template without telling names, and their articles."""
    r, rows, truth = random.Random(n), [], {}
    for i in range(n):
        paragraphs = [" ".join(r.choices(WORDS, k=r.randint(3, 9))) for _ in range(r.randint(1, 3))]
        title = f"Title {i}"
        menu = "<div class=x1><ul><li><a href=/>Home</a><li><a href=/p>Products</a><li><a href=/k>Contact</a></ul></div>"
        body = f"<h1>{title}</h1>" + "".join(f"<p>{p}" for p in paragraphs)
        body = f"<article>{body}</article>" if marked else f"<div class=c9>{body}</div>"
        end = "<div class=z><p>Made with care since 1999</p><div>All prices include tax</div></div>"
        rows.append((i, f"https://{host}/{i}", f"<html><head><title>{title}</title></head><body>{menu}<div>{body}</div>{end}"))
        truth[i] = "\n".join([title, *paragraphs])
    return rows, truth


@pytest.mark.parametrize("marked", [False, True])
@pytest.mark.parametrize("most", [sitetree.LOW_NODES, 0])
def test_repeated_branches_go(spark, marked, most, monkeypatch):
    monkeypatch.setattr(sitetree.cut_lines, "__defaults__", (most,))
    rows, truth = site(12, marked=marked)
    assert texts(spark, rows) == truth


def test_importance_is_that_of_plain_loops(spark):
    rows = site(9)[0] + [(100 + i, "http://b.example/", f"<p>x{i % 2}</p><p class=c{i}>same</p><div><p>{i}</p></div>") for i in range(6)] + site(3, "a.example")[0] + [(7, None, None)]
    stored = sitetree.parsed(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = {(r["host"], r["path"]): (r["pages"], r["importance"]) for r in sitetree.importance(sitetree.site_nodes(stored)).collect()}
    want = plain_importance(rows)
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1], abs_tol=1e-9) for k in want)
    assert any(m >= 3 and v < sitetree.THRESHOLD for m, v in got.values())


def test_equal_pages_do_not_hide_their_text(spark):
    rows, truth = site(5)
    copies = [(50 + i, rows[0][1], rows[0][2]) for i in range(40)]
    assert texts(spark, rows + copies) == truth | {50 + i: truth[0] for i in range(40)}


def test_near_copies_keep_their_text(spark):
    common = "".join(f"<p>{' '.join(random.Random(k).choices(WORDS, k=30))}</p>" for k in range(8))
    for open_, close in (("<article>", "</article>"), ("<div id=content>", "</div>")):
        got = texts(spark, [(i, "http://n.example/", f"<div>{open_}{common}<p>number {i}</p>{close}</div>") for i in range(6)])
        assert all(t.count("\n") == 8 and t.endswith(f"number {i}") for i, t in got.items())


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain words", "plain words"),
        ("<p>one<p>two", "one\ntwo"),
        ("<p>a\n  b&nbsp;&amp;&lt;c&gt; &#233;&eacute;</p>", "a b &<c> éé"),
        ("<p>a<b>b</b>c<br>d <i>e</i></p>", "abc d e"),
        ("<p><b>bold<br><p>next</b> one", "bold\nnext one"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<script>var t='</p><p>no'</script><style>p{}</style><p>yes<!-- <p>no --> it is", "yes it is"),
        ("<p>x</p><script>never closed <p>no", "x"),
        ("<body><nav>menu</nav><div class='ad-slot big'>buy</div><main><p>text</p><aside>side</aside></main><footer>end</footer>", "text"),
        ("<article><header><h1>T</h1></header><p>text</p><section class=comments><article><p>me too</p></article></section><form>mail <input></form></article>", "T\ntext"),
        ("<header>site</header><div class=page-header>h</div><div class=entry-header><h1>T</h1></div><p>text text text</p><div class=CookieNotice>ok?</div>", "T\ntext text text"),
        ("<div class='layout has-sidebar'><article><p>text</p></article><div class=sidebar>s</div></div>", "text"),
        ("<div class='sidebar wrapper'><article><p>long text of the page</p></article></div><p>x", "long text of the page"),
        ("<p hidden>no</p><p style='display: none'>no</p><p>yes <span class=advert>no</span>so</p>", "yes so"),
        ("<p title='a > b'>x</p><a href=\"un closed>y</a><p>z", "x\ny\nz"),
        ("< 3 and a<b", "< 3 and a"),
        ("<p>a</p></div></p></span><p>b", "a\nb"),
        ("<nav>only</nav>", ""),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ],
)
def test_parsing(html, text):
    assert kept(html) == text


@pytest.mark.parametrize(
    ("url", "name"),
    [(None, ""), ("", ""), ("http://A.example:80/x", "a.example"), ("https://u:p@b.example?q", "b.example"), ("//c.example/", "c.example"), ("d.example/x", "")],
)
def test_host(url, name):
    assert sitetree.host(url) == name


def test_odd_rows(spark):
    long = " ".join(WORDS * 20_000)
    rows = [(None, None, None), (1, None, "<p>a"), (1, None, "<p>a"), (None, "http://x/", ""), (2, "http://x/", f"<p>{long}"), (3, "::", "\x00<p\x00>b<>c")]
    df = spark.createDataFrame([(*r, "extra", 5) for r in rows], SCHEMA + ", text string, row int")
    got = sitetree.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted(map(tuple, got.collect()), key=str)
    assert found == sorted([(p, u, t, len(t)) for (p, u, _), t in zip(rows, ["", "a", "a", "", long, "\x00\nb<>c"])], key=str)
    assert sitetree.extract(df.limit(0)).collect() == []


def test_many_pages_of_the_test_table(spark):
    """Every page of the smallest table: what stands in its article element, as simple rules read it."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in sitetree.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>|<br>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)
