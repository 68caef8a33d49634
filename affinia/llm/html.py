"""Main text of web pages by consensus host paths.

A page is read as a stream of tags and text. Every container (a block element)
has a path of generalised tag-class names, such as `html/body/div.post`, with
digits taken out of class names. The containers of a page are scored by the text
of their own blocks, less link text; the pages of a host then vote, in Spark,
for paths with their scores, and the host's winning path is used to extract every
page of the host that has it. Pages without it use their own best container.

The best container is often a box inside the article, with headings, lead and
closing paragraphs beside it. Each page therefore also says how far its container
can be widened: up to the outermost container that adds only text with few links.
The host takes the widest step that pages with half of the votes agree to. `body`,
`html` and the top of a fragment are no containers of an article: they are taken
only where all they add are headings, paragraphs, lists and tables of their own.

What never counts as text: head, scripts, styles, the controls of forms, menus, and
the elements header, footer and aside. A form, and an element whose class or id has
a name such as advert, sidebar or comments (not `has-sidebar`, `tag-news` or `entry-header`, which say
something of another part), are in doubt: their text counts little in the scores and
is left out, unless the winning container is in it. Inline elements of such names
are left out at the edges of a block only. Where such elements of one
path hold most of a page's text, they are taken like any other, comments only
where next to nothing else is there, and neither beside an article or main
element with text of its own.

Defined results: null or empty html gives an empty text; a null url, or one
without a host, votes in a group of its own per page (no consensus); repeated
rows give a row each; an empty table gives an empty table. Only the named columns
are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinia.llm.words import pieces

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(
    "script style textarea title noscript template svg annotation annotation-xml iframe object canvas select button label legend datalist "
    "xmp noembed noframes".split()
)
SKIPPED = frozenset("head nav header footer aside dialog menu video audio".split())
FORMS = frozenset("form fieldset".split())  # in doubt: some pages are one form
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded mphantom mspace semantics".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
# An opening tag ends an open element of the listed names, looked for up to the nearest list or table.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table body html article section div main".split())
COMMENTS = re.compile(r"(?:^|[^a-z])(?:comments?|commentlist|discussion|disqus|repl(?:y|ies)|respond)(?:$|[^a-z])")
BOILERPLATE = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|popup|modal|"
    r"overlay|menus?|nav|navbar|navigation|breadcrumbs?|sidebars?|side|aside|footer|foot|header|masthead|topbar|toolbar|"
    r"reviews?|share|sharing|social|related|recommend\w*|"
    r"newsletter|subscri\w*|signup|login|search|pagination|pager|paging|widgets?|tags?|skip|copyright|legal|hidden)(?:$|[^a-z])"
)
# What a class says of the page around it or of its subject, not of its own part; the header of an article is its title.
MODIFIER = re.compile(
    r"^(?:category|tag(?!-(?:cloud|links?|lists?|box|items?)$))-.*|(?:^|-)(?:has|have|no|non|not|with|without)-+[a-z]+|"
    r"^(?:entry|post|article|story|content)-+header$"
)
# Ends the name of a container in doubt; no class has a blank.
DOUBT = {"part": " ?", "comments": " ??"}
LOW = 0.02  # weight of text in doubt
LEAVES = frozenset("p pre li td th dt dd blockquote h1 h2 h3 h4 h5 h6 tr".split())
PLAIN = LEAVES | frozenset("ul ol dl table thead tbody tfoot caption hgroup center address".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|$))|<![^>]*>?|<\?[^>]*>?|"
    # a quote opens a value right after `=` alone
    r"<(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>?",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.S)
_SPACE = re.compile(r"\s+")


def _attributes(text: str) -> dict[str, str]:
    return {name.lower(): unescape(a or b or c) for name, a, b, c in _ATTR.findall(text)}


def _segment(name: str, attrs: dict[str, str]) -> str:
    # a slash separates the names of a path
    words = sorted({w for w in re.sub(r"\d+", "", attrs.get("class", "").lower()).replace("/", "_").split() if w.strip("-_")})
    return ".".join([name, *words])


def _name(segment: str) -> str:
    return segment.split(" ")[0].split(".")[0]


def _unwanted(name: str, attrs: dict[str, str]) -> bool:
    return name in SKIPPED or attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true"


def _doubt(name: str, attrs: dict[str, str]) -> str:
    """The ending of a container whose class or id names a part beside the text, or nothing."""
    if name in FORMS:
        return DOUBT["part"]
    said = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    if not said.strip() or name in ("body", "html", "main", "article"):
        return ""
    # fooBar and foo_bar read as two words
    names = [MODIFIER.sub("", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).replace("_", "-").lower()) for token in said.split()]
    if any(COMMENTS.search(n) for n in names):
        return DOUBT["comments"]
    return DOUBT["part"] if any(BOILERPLATE.search(n) for n in names) else ""


def _without_labels(text: list[str], labels: list[list]) -> tuple[str, list[str]]:
    """The text of a block, and the ending of its path.

    Inline elements in doubt are left out at the start and the end of a block that says more than they do;
    within a sentence they are part of it. A block of nothing else is itself in doubt, as its longest element is.
    """
    closed = [(a, b, segment) for a, b, _, segment in labels if b is not None]
    size = [len(part.strip()) for part in text]
    inside = [any(a <= i < b for a, b, _ in closed) for i in range(len(text))]
    ending: list[str] = []
    if closed and not any(n for n, label in zip(size, inside) if not label):
        a, b, segment = max(closed, key=lambda c: sum(size[c[0] : c[1]]))
        inside[a:b] = [False] * (b - a)
        ending = [segment]
    own = [i for i, n in enumerate(size) if n and not inside[i]]
    first, last = (own[0], own[-1]) if own else (0, len(text))
    said = sum(size[i] for i in own)
    head, tail = sum(size[:first]), sum(size[last + 1 :])
    kept = text[first if head < said else 0 : last + 1 if tail < said else len(text)]
    return _SPACE.sub(" ", "".join(kept)).strip(), ending


def blocks(html: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(container path, text, characters of it in links) of every text block in page order; names of containers in doubt end so."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    names, path, bad = ["#"], ["#"], [False]  # open containers from the outside in
    text, links, in_link = [], 0, 0
    labels: list[list] = []  # inline elements in doubt: first and last place in `text`, element name, segment
    at, size = 0, len(html)

    def flush() -> None:
        nonlocal links
        if text:
            joined, segment = _without_labels(text, labels)
            if joined:
                out.append((tuple(path[1:] + segment), joined, min(links, len(joined))))
            text.clear()
        labels.clear()
        links = 0

    def say(raw: str) -> None:
        nonlocal links
        if raw and not bad[-1]:
            clean = unescape(raw)
            text.append(clean)
            if in_link:
                links += len(clean.strip())

    def close_upto(index: int) -> None:
        flush()
        del names[index:], path[index:], bad[index:]

    while at < size:
        found = _TOKEN.search(html, at)
        if not found:
            say(html[at:])
            break
        say(html[at : found.start()])
        at = found.end()
        name = found["name"]
        if name is None:
            continue
        name = name.lower()
        if found["close"]:
            if name == "a":
                in_link = max(0, in_link - 1)
            elif name in INLINE:
                for label in reversed(labels):
                    if label[1] is None and label[2] == name:
                        label[1] = len(text)
                        break
                continue
            elif name in names:
                close_upto(len(names) - 1 - names[::-1].index(name))
                in_link = 0
            elif name in ("p", "br"):
                flush()
            continue
        if name in VOID:
            if name != "wbr" and not bad[-1]:
                text.append(" ")
            if name == "hr":
                flush()
            continue
        if name in RAW:
            if not found["attrs"].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                at = end.end() if end else size
            continue
        if name in INLINE:
            if name == "a":
                in_link = 1
            if found["attrs"].strip() and name != "a":
                attrs = _attributes(found["attrs"])
                if _unwanted(name, attrs):
                    end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
                    if end:
                        at = end.end()
                elif _doubt(name, attrs):
                    labels.append([len(text), None, name, _segment(name, attrs) + _doubt(name, attrs)])
            continue
        if name in CLOSES_P and "p" in names:
            close_upto(len(names) - 1 - names[::-1].index("p"))
        elif name in CLOSES:
            for i in range(len(names) - 1, 0, -1):
                if names[i] in CLOSES[name]:
                    close_upto(i)
                    break
                if names[i] in SCOPE:
                    break
        flush()
        attrs = _attributes(found["attrs"]) if found["attrs"].strip() else {}
        if name in ("html", "body") and name in names:
            continue
        names.append(name)
        path.append(_segment(name, attrs) + _doubt(name, attrs))
        bad.append(bad[-1] or _unwanted(name, attrs))
        in_link = 0
    flush()
    return out


def _in_doubt(found: list[tuple[tuple[str, ...], str, int]]) -> list[list[int]]:
    """Per block, the places in its path of the containers in doubt, without those that hold most of the page."""
    places = [[i for i, segment in enumerate(path) if segment.endswith(" ?") or segment.endswith(" ??")] for path, _, _ in found]
    if not any(places):
        return places
    held: dict[tuple[str, ...], int] = {}
    stated = set()
    total = 0
    for (path, text, links), at in zip(found, places):
        plain = max(0, len(text) - links)
        total += plain
        if not at:
            stated.update(path[: i + 1] for i, segment in enumerate(path) if _name(segment) in ("article", "main"))
        for i in at:
            held[path[: i + 1]] = held.get(path[: i + 1], 0) + plain
    most = {
        path for path, n in held.items()
        if n * 10 > total * (9 if path[-1].endswith(DOUBT["comments"]) else 5) and all(path[: len(s)] == s for s in stated)
    }
    return [[i for i in at if path[: i + 1] not in most] for (path, _, _), at in zip(found, places)]


def container_scores(found: list[tuple[tuple[str, ...], str, int]]) -> dict[str, float]:
    """Score of every container path: text outside links, in full for the block's parent, less for those further out.

    Text in doubt counts little, and only for containers inside the one in doubt.
    """
    number: dict[tuple[int, str], int] = {}  # of a path, by that of the path before its last name
    scores: dict[int, float] = {}
    for (path, text, links), doubts in zip(found, _in_doubt(found)):
        plain = len(text) - 2 * links
        if plain <= 0 or len(text) < 10:
            continue
        inside = doubts[-1] + 1 if doubts else 0
        top = len(path) - 1 if path and _name(path[-1]) in LEAVES else len(path)
        nodes, node = [], 0
        for segment in path[:top]:
            node = number.setdefault((node, segment), len(number) + 1)
            nodes.append(node)
        share = plain * LOW ** len(doubts)
        for depth in range(top, max(inside, 1) - 1, -1):
            scores[nodes[depth - 1]] = scores.get(nodes[depth - 1], 0.0) + share
            share *= 0.8
    texts, out = {0: ""}, {}
    for (before, segment), node in number.items():
        texts[node] = f"{texts[before]}/{segment}" if before else segment
        if node in scores:
            name = _name(segment)
            out[texts[node]] = scores[node] * (1.5 if name in ("article", "main") else 0.5 if name in ("body", "html") else 1.0)
    return out


def best_container(found: list[tuple[tuple[str, ...], str, int]]) -> tuple[str, float]:
    scores = container_scores(found)
    if not scores:
        return "", 0.0
    path, score = max(sorted(scores.items()), key=lambda kv: kv[1])
    want, doubts = _parts(path), _in_doubt(found)
    if not all(doubts) and any(at and at[0] < len(want) and block[: len(want)] == want for (block, _, _), at in zip(found, doubts)):
        return "", 0.0  # what is not in doubt, however short
    return path, score


def _common(path: tuple[str, ...], want: tuple[str, ...]) -> int:
    """How many leading names two paths share."""
    n = 0
    while n < len(want) and n < len(path) and path[n] == want[n]:
        n += 1
    return n


def _parts(container: str) -> tuple[str, ...]:
    return tuple(container.split("/")) if container else ()


def _page_levels(want: tuple[str, ...]) -> int:
    """How many names at the start of a path stand for the page as a whole."""
    n = 0
    while n < len(want) and _name(want[n]) in ("html", "body"):
        n += 1
    return n


def outer_depth(found: list[tuple[tuple[str, ...], str, int]], container: str) -> int:
    """Names left of the container's path when it is widened as long as what is added has few links."""
    want = _parts(container)
    page = _page_levels(want)
    chars, linked, boxed = [0] * len(want), [0] * len(want), [False] * len(want)
    for (path, text, links), doubts in zip(found, _in_doubt(found)):
        n = _common(path, want)
        if n < len(want) and (not doubts or doubts[-1] < n):
            chars[n] += len(text)
            linked[n] += links
            boxed[n] = boxed[n] or any(_name(segment) not in PLAIN for segment in path[n:])
    best, all_chars, all_links = len(want), 0, 0
    for depth in range(len(want) - 1, -1, -1):
        all_chars += chars[depth]
        all_links += linked[depth]
        if all_links * 3 > all_chars or (depth <= page and boxed[depth]):
            break
        best = depth
    return best


def text_around(found: list[tuple[tuple[str, ...], str, int]], container: str, depth: int) -> str | None:
    """Texts of the blocks below the first `depth` names of the container path; None if the page has no such container."""
    want = _parts(container)
    if not any(path[: len(want)] == want for path, _, _ in found):
        return None
    page = _page_levels(want)
    if depth <= page < len(want):  # other boxes of this page may lie beside the container
        own = outer_depth(found, container)
        depth = max(depth, own) if own <= page else page + 1
    kept = [
        text for (path, text, _), doubts in zip(found, _in_doubt(found))
        if path[:depth] == want[:depth] and (not doubts or doubts[-1] < _common(path, want))
    ]
    return " ".join(kept if kept or want else [text for _, text, _ in found])


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "_html"):
        paths, depths, scores = [], [], []
        for html in batch.column("_html").to_pylist():
            found = blocks(html or "")
            path, score = best_container(found)
            paths.append(path)
            depths.append(outer_depth(found, path))
            scores.append(score)
        yield pa.RecordBatch.from_arrays(
            [batch.column("_host"), pa.array(paths, pa.string()), pa.array(depths, pa.int32()), pa.array(scores, pa.float64())],
            ["_host", "path", "depth", "score"],
        )


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "_html"):
        texts = []
        for html, path, depth in zip(*(batch.column(c).to_pylist() for c in ("_html", "path", "depth"))):
            found = blocks(html or "")
            got = text_around(found, path, depth) if path is not None else None
            if got is None:
                own = best_container(found)[0]
                got = text_around(found, own, outer_depth(found, own))
            texts.append(got or "")
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string())], ["_id", "_url", "text"]
        )


# A host with more than this part of all pages is dealt over several keys, about so many pages each.
HOST_PARTS = 4096


def _large_hosts(rows: DataFrame) -> DataFrame:
    """(_host, _keys) of the hosts that are dealt over several keys: at most `HOST_PARTS` rows."""
    counts = rows.where(F.col("_host") != "").groupBy("_host").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    keys = F.least(F.col("n"), F.ceil(F.col("n") * HOST_PARTS / F.lit(max(total, 1))))
    return F.broadcast(counts.where(F.col("n") * HOST_PARTS > total).select("_host", keys.cast("bigint").alias("_keys")))


def host_paths(pages: DataFrame) -> DataFrame:
    """(_host, path, depth): the path with most votes, weighted by score; ties go to the last in order.

    `depth` is the smallest that pages with half of the path's votes agree to.
    """
    by_depth = (
        pages.where(F.col("_host") != "").select("_host", "_html")
        .mapInArrow(_vote, "_host string, path string, depth int, score double")
        .where("path <> ''")
        .groupBy("_host", "path", "depth")
        # whole numbers, so that the sum does not depend on the order of the rows
        .agg(F.sum((F.log1p("score") * 1000).cast("bigint")).alias("votes"))
    )
    # a row per name of the path at most
    votes = by_depth.groupBy("_host", "path").agg(F.sum("votes").alias("votes"), F.collect_list(F.struct("depth", "votes")).alias("steps"))
    best = votes.groupBy("_host").agg(F.max_by(F.struct("votes", "path", "steps"), F.struct("votes", "path")).alias("best")).select("_host", "best.*")

    def agreed(step):
        wider = F.filter("steps", lambda s: s["depth"] <= step["depth"])
        return F.aggregate(wider, F.lit(0).cast("bigint"), lambda total, s: total + s["votes"]) * 2 >= F.col("votes")

    return best.select("_host", "path", F.array_min(F.transform(F.filter("steps", agreed), lambda s: s["depth"])).alias("depth"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    url = F.col(url_col).cast("string")
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(
        F.col(id_col).alias("_id"), url.alias("_url"), F.coalesce(host, F.lit("")).alias("_host"), F.col(html_col).alias("_html")
    )
    large, keys = _large_hosts(rows), F.coalesce("_keys", F.lit(1).cast("bigint"))
    winners = host_paths(rows).join(large, "_host", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), keys - 1)))
    salted = rows.join(large, "_host", "left").withColumn("_salt", F.pmod(F.xxhash64("_id", "_url"), keys))
    met = salted.join(winners.drop("_keys"), ["_host", "_salt"], "left").select("_id", "_url", "_html", "path", "depth")
    schema = T.StructType([rows.schema["_id"], T.StructField("_url", T.StringType()), T.StructField("text", T.StringType())])
    return met.mapInArrow(_extract, schema).select(
        F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", F.char_length("text").cast("bigint").alias("n_chars")
    )
