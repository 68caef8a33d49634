"""Vectors, pages and archives against brute force and round trips; registered queries against their SQL."""

import base64
import gzip
import hashlib
import io
import math
from collections import Counter

import __spark_entry__ as entry_points
import numpy as np
import pytest
from compare import difference, duck

from affinia.llm import html, near_vectors, queries, warc
from affinia.llm.components import components

SF_DIR = "/root/testdata/sf0.001"


def roots(n, links):
    label = list(range(n))
    moved = True
    while moved:
        moved = False
        for a, b in links:
            least = min(label[a], label[b])
            moved |= label[a] != least or label[b] != least
            label[a] = label[b] = least
    return label


@pytest.mark.parametrize("slice_", [2048, 4])
def test_near_vectors(spark, slice_, monkeypatch):
    monkeypatch.setattr(near_vectors, "SLICE", slice_)
    rng = np.random.default_rng(9)
    base = rng.standard_normal((120, 16))
    rows = [v.tolist() for v in base]
    rows += [(v + rng.standard_normal(16) * s).tolist() for v in base[:30] for s in (0.05, 0.2, 0.3)]
    rows += [rows[0]] * 5 + [(3 * base[1]).tolist(), (-base[2]).tolist(), (1e-200 * base[3]).tolist()]
    rows += [None, [], [0.0] * 16, [math.nan, *[1.0] * 15], [math.inf, *[1.0] * 15], [None, *[1.0] * 15], base[4, :8].tolist()]
    frame = spark.createDataFrame(list(enumerate(rows)), "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS node", "'x' AS cell")
    unit = {}
    for i, v in enumerate(rows):
        if v and None not in v and np.isfinite(v).all() and any(v):
            v = np.array(v) / np.abs(v).max()
            unit[i] = v / np.linalg.norm(v)
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    degree, root = Counter(x for pair in links for x in pair), roots(len(rows), links)
    got = {r["vec_id"]: r for r in near_vectors.near_duplicates(frame, recall=1 - 1e-6).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert (r["n_links"], r["component_id"], r["kept"]) == (degree[i], root[i], root[i] == i)
    assert near_vectors.near_duplicates(frame.limit(0)).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    plan = near_vectors.calibrate(100_000)
    a = rng.standard_normal((2000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((2000, 32))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * b
    (ka, pa_), (kb, pb) = near_vectors.project(a, plan), near_vectors.project(b, plan)
    met = ((ka == kb) & (abs(pa_ - pb) <= plan.window)).sum(axis=1) >= near_vectors.MIN_COLLISIONS
    assert met.mean() > 0.98


def test_components(spark):
    rng = np.random.default_rng(6)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 90, (60, 2))] + [(k, k + 1) for k in range(200, 260)] + [(300, k) for k in range(301, 340)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = roots(400, links)
    assert set(got) == {x for a, b in links if a != b for x in (a, b)}
    assert len({(want[n], r) for n, r in got.items()}) == len({want[n] for n in got}) == len(set(got.values()))
    assert components(spark.createDataFrame([(1, 1)], "a bigint, b bigint")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="<p>no</p>";</script><style>p{}</style></head><body class="page-%d">
<header><h2>Site</h2></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies on this site, many of them.</div>
<div class="post p%d"><h1>Title &amp; more</h1><p>First  paragraph\nwith <b>bold</b>text &lt;here&gt; and so on for a while.<p>Second &eacute; one,<br>broken
<form><input><p>Search here for something else entirely</form><div class="ad-box">Buy this now, it is cheap</div><ul><li>an item</li></ul></div>
<div class="sidebar">Other things that are not the text</div><div id="comments"><p>Reader says a very long thing about it all, again and again and again,
again and again and again, again and again and again, again and again.</p></div><footer>&copy; us</footer></body></html>"""
MAIN = "Title & more First paragraph with boldtext <here> and so on for a while. Second é one, broken an item"


def test_main_text(spark):
    rows = [(i, f"http://Host.example/{i}", PAGE % (i, i)) for i in range(6)]
    rows += [(10, "http://host.example/odd", "<p>only a paragraph, nothing else</p>"), (11, None, None), (12, "not a url", ""), (13, None, PAGE % (1, 1)), (0, rows[0][1], rows[0][2])]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' AS path", "1 AS _salt")
    got = html.extract(frame).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert all(by[i]["text"] == MAIN and by[i]["n_chars"] == len(MAIN) for i in [*range(6), 13])
    assert by[10]["text"] == "only a paragraph, nothing else"
    assert (by[11]["text"], by[12]["text"], by[11]["url"]) == ("", "", None)
    assert html.extract(frame.limit(0)).count() == 0


def test_host_path_overrules_one_page(spark):
    body = "<div class='story'><p>%s</p></div><div class='more'><p>%s</p></div>"
    rows = [(i, "http://h/x", body % (f"the story number {i} is told at length here", "short extra text")) for i in range(5)]
    rows.append((9, "http://h/y", body % ("a brief story", "this time the other box holds by far the longest text of the page, for once only")))
    got = dict(html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).select("page_id", "text").collect())
    assert got[9] == "a brief story"


def own_text(page):
    found = html.blocks(page)
    path = html.best_container(found)[0]
    return html.text_around(found, path, html.outer_depth(found, path))


def test_text_beside_the_largest_box_is_kept(spark):
    """Headings, lead and closing paragraphs around an inner box, at one level and at two, by host and without."""
    def story(i):
        return f"sentence {i} of a long story, and on it goes. " * 25

    def page(i):
        lead = f"<p>lead paragraph number {i}</p>" if i % 3 else ""
        return (
            f"<html><body><div class='top'><a href='/'>home of the host</a> <a href='/b'>all the others</a></div><div class='page'><div class='post'><h1>heading number {i}</h1>{lead}"
            f"<div class='entry'><p>{story(i)}</p></div><p>closing words number {i}</p></div><div class='after'>notes by the author {i}</div></div>"
            f"<div class='else'>an unrelated box</div></body></html>"
        )

    def want(i):
        lead = f"lead paragraph number {i} " if i % 3 else ""
        return f"heading number {i} {lead}{story(i).strip()} closing words number {i} notes by the author {i}"

    rows = [(i, "http://h/x" if i < 9 else None, page(i)) for i in range(12)]
    got = dict(html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).select("page_id", "text").collect())
    assert got == {i: want(i) for i in range(12)}
    body = "<body><h1>heading of it</h1><div class='entry'><p>%s</p></div><p>closing words</p>%s</body>"
    assert own_text(body % (story(0), "")) == f"heading of it {story(0).strip()} closing words"
    assert own_text(body % (story(0), "<div>an unrelated box</div>")) == story(0).strip()
    linked = "<div class='page'><div class='entry'><p>%s</p></div><div><a href='/'>other stories to read</a></div></div>"
    assert own_text(linked % story(0)) == story(0).strip()


def test_names_of_parts_do_not_empty_a_page(spark):
    """Modifiers in class names, parts that hold most of the text, and real parts beside the text."""
    story = "a sentence of a story that is told at some length here. " * 12
    aside = "<div class='%s'><p>words that are beside the story, in a box of its own</p></div>"
    wrappers = [
        "class='site has-sidebar'", "class='content with-sidebar'", "class='container no-sidebar'", "class='wrap fixed-header'",
        "class='post tag-news'", "class='review'", "id='legal'", "class='post comments-open'", "class='w-1/2'", "class='layout--with-sidebar'",
    ]
    pages = [f"<body><div {w}><div class='entry-header'><h1>the heading of it</h1></div><p>{story}</p>{aside % 'sidebar'}</div></body>" for w in wrappers]
    for hosts in (False, True):
        rows = [(i, f"http://h{i if hosts else ''}/x" , p) for i, p in enumerate(pages)]
        got = dict(html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).select("page_id", "text").collect())
        assert got == {i: f"the heading of it {story.strip()}" for i in range(len(pages))}
    talk = "<div id='comments'><p>%s</p></div>" % ("a reader has much to say about it. " * 60)
    for part in [aside % "ad-box", aside % "content-sidebar", aside % "tag-cloud", aside % "siteHeader", aside % "related_posts", talk]:
        assert own_text(f"<body><div class='post'><p>{story}</p></div>{part}</body>") == story.strip()
        assert own_text(f"<body><div class='post'><p>{story}</p>{part}</div></body>") == story.strip()
    label = "<span class='tag'>news</span>"
    assert own_text(f"<body><div class='post'><p>{label}<span class='review'>{story}</span></p></div></body>") == story.strip()
    assert own_text("<body><div class='sidebar'>all there is</div></body>") == "all there is"


def test_broken_pages_do_not_crash():
    for page in ("<", "<p", "</", "<!--", "<a href='x", "&#0;&#xffffffff;&bogus;", "<div><p></div></p></p><td><li>x", "<script>never closed", "<b" * 2000, "a<b>c</b" * 500):
        html.best_container(html.blocks(page))
    deep = html.blocks("<div>" * 3000 + "deep text" + "</div>" * 3000)
    assert [b[1] for b in deep] == ["deep text"]


def test_text_in_forms_figures_formulas_and_labels_is_kept():
    story = "<p>The story is told here, at some length and in full, and then it goes on.</p>"
    told = "The story is told here, at some length and in full, and then it goes on."
    form = f"<body><form id='aspnet'><input><label>Name</label><select><option>x</option></select><div class=post>{story * 3}</div></form></body>"
    assert own_text(form) == " ".join([told] * 3)
    search = f"<body><article>{story * 3}<form><p>Search this site for more</p><button>Go</button></form></article></body>"
    assert own_text(search) == " ".join([told] * 3)
    figure = f"<article>{story}<figure><pre>x = 1</pre><figcaption>A listing.</figcaption></figure>{story}</article>"
    assert own_text(figure) == f"{told} x = 1 A listing. {told}"
    assert own_text(f"<article>{story}<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>") == f"{told} so x=2 holds"
    label = 'We <span class="tag">X</span> and <em class="notice">Y</em> here'
    assert own_text(f"<article>{story}<p>{label}</p></article>") == f"{told} We X and Y here"
    edge = '<p><span class="tag">News</span> The day was long and the night was longer <span class="share">Share</span></p>'
    assert own_text(f"<article>{story}{edge}</article>") == f"{told} The day was long and the night was longer"
    assert own_text(f'<article>{story}<p><span class="tag">News</span></p></article>') == told


def test_quotes_and_comments_that_do_not_close():
    assert own_text('<div><p class=x">FIRST paragraph</p><p class="y">second one</p></div>') == "FIRST paragraph second one"
    assert own_text("<div><p title='a > b' class=\"z > w\">kept text</p><!-- no --!><p>after it</p><!--><p>and more</p></div>") == "kept text after it and more"
    assert own_text('<div><p data-x="never closed>lost? no</p><p>more text</p></div>') == "lost? no more text"


def test_deep_pages_take_little_time():
    import time

    page = "".join(f"<div class=a{i}b><p>text number {i} of a deep page" for i in range(2000))
    start = time.perf_counter()
    assert html.best_container(html.blocks(page))[1] > 0
    assert time.perf_counter() - start < 10


def test_large_hosts_are_dealt_over_keys(spark):
    rows = spark.createDataFrame([("a",)] * 900 + [("b",)] * 99 + [("",)] * 50, "_host string")
    keys = dict(html._large_hosts(rows).collect())
    assert keys == {"a": 900, "b": 99}  # as many as pages, at most
    few = spark.range(20_000).selectExpr("CASE WHEN id < 10000 THEN 'hot' ELSE CONCAT('h', id) END AS _host")
    assert html._large_hosts(few).where("_host = 'hot'").first()["_keys"] == 2048 and html._large_hosts(few).count() == 1


def test_warc_round_trip(spark, tmp_path):
    big = "long payload é " * 200_000
    rows = [(1, "http://a/1", "same"), (5, "http://a/5", "same"), (3, None, "same"), (2, "http://b\r\nX: y/é", None), (4, "u", ""), (6, "v", big), (7, "w", "a\r\n\r\nb"), (None, "n", "same"), (5, "again", "same")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3).selectExpr("*", "'x' AS payload", "0 AS record_type")
    path = str(tmp_path / "w")
    got = warc.page_round_trip(pages, path).collect()
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = Counter()
    for i, _, h in rows:
        body = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        first = i == last[h or ""]
        want[i, len(body), digest, "response" if first else "revisit", None if first else last[h or ""]] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    # any reader of gzip finds whole records, and headers alone leave the payload packed
    raw = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "w").glob("*.warc.gz")))
    assert raw.count(b"WARC/1.1\r\n") == len(rows) and b"http://b%0D%0AX: y/" in raw
    heads = warc.read_warc(spark, path)
    assert heads.where("payload is not null").count() == 0
    plan = heads.where("record_type = 'revisit' and target_uri in ('http://a/1', 'n')")
    assert plan.count() == 2
    plain = tmp_path / "plain.warc"
    plain.write_bytes(raw)
    assert warc.read_warc(spark, str(plain), payload=True).where("record_type = 'response'").count() == sum(n for w, n in want.items() if w[3] == "response")
    assert warc.page_round_trip(pages.limit(0), str(tmp_path / "none")).count() == 0


def test_min_payload_bytes(spark):
    pages = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long one"), (4, "d", "long one")], "page_id bigint, url string, html string")
    got = {r["record_id"]: r["record_type"] for r in warc.page_records(pages, min_payload_bytes=3).collect()}
    assert [got[f"<urn:page:{k}>"] for k in (1, 2, 3, 4)] == ["response", "response", "revisit", "response"]


def test_reader_steps_over_members():
    members = [warc.gzip_member(warc.record_bytes({"record_type": "response", "record_id": f"<urn:page:{k}>", "payload_digest": "", "target_uri": None, "payload": b"z" * 99_999, "payload_bytes": 99_999, "refers_to": None}, "d")) for k in range(4)]

    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            got = super().read(n)
            Counting.taken += len(got)
            return got

    raw = b"".join(members)
    noise = np.random.default_rng(0).bytes(500_000)
    big = warc.gzip_member(warc.record_bytes({"record_type": "resource", "record_id": "<urn:page:9>", "payload_digest": "", "target_uri": None, "payload": noise, "payload_bytes": len(noise), "refers_to": None}, "d"))
    file = Counting(big + raw)
    got = list(warc.read_records(file, len(big + raw), True, True, False, lambda r: r["record_type"] == "response"))
    assert [r["record_id"] for r in got] == [f"<urn:page:{k}>" for k in range(4)] and all(r["payload"] == b"z" * 99_999 for r in got)
    assert Counting.taken < 50_000  # the unwanted half megabyte was stepped over


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF_DIR), duck(SF_DIR), queries.ORACLES[name]) is None


def test_registered():
    names = entry_points.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 14)}
    assert "pipeline" in names
