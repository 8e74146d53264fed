"""Wrapper induction, product codes and the filter audit: plain versions, and odd inputs."""

import hashlib
import itertools
import re
from html import unescape

import numpy as np

from noteskein.llm import filter_audit, html_tree, product_codes, wrappers
from noteskein.llm import queries as registered

LOREM = "Some words of a text that goes on for a while, number {0}, and then it ends."


def texts(spark, rows):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in wrappers.extract(frame).collect()}


def blocks(html):
    return [b.text for b in html_tree.read_page(html).blocks]


def test_tables_against_patterns(spark, sf_dir):
    """The pages of the tables have one article each, in which blocks are headings and paragraphs."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = registered.QUERIES["op11_wrapper_induction"](spark, sf_dir)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    found = {r["page_id"]: r for r in found.collect()}
    assert len(found) == pages.count()
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?p>|</?h1>", article)]
        wanted = "\n\n".join(p for p in parts if p)
        assert (found[r["page_id"]]["text"], found[r["page_id"]]["n_chars"], found[r["page_id"]]["url"]) == (wanted, len(wanted), r["url"])


def test_constant_nodes_are_template_and_varying_ones_text(spark):
    page = (
        "<body><div class=x1>Welcome to our site</div><div class=x2><a href=/{0}>one {0}</a> <a href=/b>two {0}</a></div>"
        "<div class=x3><h1>Title {0}</h1><p>" + LOREM + "<p>Second, {0}.</div><div class=x4>All rights reserved</div></body>"
    )
    rows = [(n, f"https://User@Host.example:8080/{n}", page.format(n)) for n in range(5)]
    # Copies of one text do not make a template of it, and two pages are no evidence.
    rows += [(n, "//copies.example/", page.format(7).replace("one", f"one{n}")) for n in range(10, 16)]
    rows += [(n, "http://few.example", page.format(n)) for n in (20, 21)]
    found = texts(spark, rows)
    for n in range(5):
        assert found[n] == f"Title {n}\n\n{LOREM.format(n)}\n\nSecond, {n}."
    for n in range(10, 16):
        assert found[n] == f"Welcome to our site\n\nTitle 7\n\n{LOREM.format(7)}\n\nSecond, 7.\n\nAll rights reserved"
    assert found[20].startswith("Welcome to our site\n\nTitle 20\n\n") and found[20].endswith("All rights reserved")


def test_pages_of_another_shape_meet_the_template(spark):
    page = "<body><div>Our site</div>{1}<div>News</div><div><p>" + LOREM + "<p>Subscribe now!</div><section>Imprint</section></body>"
    rows = [(n, "http://h.example", page.format(n, "")) for n in range(8)]
    rows += [(n, "http://h.example", page.format(n, f"<div class=x9><h2>More {n}</h2></div>")) for n in (8, 9)]
    found = texts(spark, rows)
    assert found[8] == f"More 8\n\n{LOREM.format(8)}" and found[0] == LOREM.format(0)


def test_parts_beside_the_text(spark):
    html = """<!doctype html><html><head><title>T</title><script>if (a<b) "</p>"</script></head><body class="no-sidebar menu-open">
      <header><h1>Site</h1></header><nav><ul><li><a href=a>Home</a></ul></nav><div id="cookieConsent">We use cookies</div>
      <div class="has-sidebar"><article class="post"><header><h1>The&nbsp;title</h1></header><div class=share>Share this</div>
      <p>One &lt;b&gt; <b>bold</b><script>x()</script> end<br>line<p>Two<span class="ad-slot">Buy <span>now</span></span> more
      <ul><li>a<li>b <a href=x>c</a></ul><table><tr><td>1<td>2<tr><td>3</table><pre> x
        y </pre><form><p>Name<input></form><aside>Related</aside><!-- <p>no</p> --><p style="display: none">hidden</p>
      <div class="comments"><p>First!</p></div></article></div><aside>Side</aside>
      <section id=comments><article class=comment><p>Nice</article></section><footer>(c)</footer></body></html>"""
    assert texts(spark, [(1, "http://a.b", html)])[1].split("\n\n") == [
        "The title", "One <b> bold end line", "Two more", "a", "b c", "1", "2", "3", "x y",
    ]


def test_broken_pages_are_read_to_their_end():
    assert blocks("<p>a <a title=it's>b</a><p>c</p></p></div>d<br/>e<li>f<p>g<td>h") == ["a b", "c", "d e", "f", "g", "h"]
    assert blocks("a &amp b &am; < c <p") == ["a & b &am; < c"]
    assert blocks("<p>a<!-- b") == ["a"] and blocks("<p>a<script>b") == ["a"] and blocks("x<title>y") == ["x"]
    assert blocks("") == [] and blocks("<![CDATA[x]]>y<?php z ?>") == ["y"]
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    assert blocks(deep) == ["x"]
    shape, place = html_tree.collapsed(html_tree.read_page(deep))
    assert html_tree.align(shape, shape) == list(range(len(place)))


def test_runs_are_one_node():
    one, _ = html_tree.collapsed(html_tree.read_page("<body><ul><li>a<li>b</ul><p>a<p>b<div><p>c</div><div><p>d<p>e</div>"))
    other, place = html_tree.collapsed(html_tree.read_page("<body><ul><li>a</ul><p>a<div><p>c</div>"))
    assert one == other and place == [0, 1, 2, 3, 4, 5, 6]


def plain_matching(a, b):
    """Simple tree matching as its recursion says, on (label, children)."""
    if a[0] != b[0]:
        return 0
    rows = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1], 1):
        for j, y in enumerate(b[1], 1):
            rows[i][j] = max(rows[i - 1][j], rows[i][j - 1], rows[i - 1][j - 1] + plain_matching(x, y))
    return 1 + rows[-1][-1]


def test_alignment_is_as_large_as_simple_tree_matching():
    draw = np.random.default_rng(5)

    def tree(depth):
        children = [tree(depth - 1) for _ in range(draw.integers(0, 4))] if depth else []
        return "abc"[draw.integers(3)], children

    def lines(node, depth=0):
        return [f"{depth} {node[0]}", *(line for c in node[1] for line in lines(c, depth + 1))]

    for _ in range(300):
        a, b = ("r", [tree(3), tree(2)]), ("r", [tree(3), tree(3)])
        one, other = lines(a), lines(b)
        match = html_tree.align("\n".join(one), "\n".join(other))
        pairs = [(i, j) for i, j in enumerate(match) if j >= 0]
        assert len(pairs) == plain_matching(a, b)
        assert all(one[i] == other[j] for i, j in pairs) and [j for _, j in pairs] == sorted({j for _, j in pairs})


def test_pages_odd(spark):
    rows = [
        (1, None, None, 1, "a"), (1, None, None, 1, "a"), (None, "http://x", "", 2, "b"), (2, "no url", "only text", 3, None),
        (3, "http://x", "<p>" + "word " * 60_000, 4, "c"), (4, "http://[::1]:80/", "<p>é\U0001f600 &#0; &#xD800;", 5, ""),
        (5, "http://x", "<nav>a</nav>", 6, ""),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host int, reference string")
    found = [tuple(r) for r in wrappers.extract(frame).collect()]
    wanted = [
        (1, None, "", 0), (1, None, "", 0), (None, "http://x", "", 0), (2, "no url", "only text", 9),
        (3, "http://x", ("word " * 60_000).strip(), 299_999), (4, "http://[::1]:80/", "é\U0001f600 � �", 6), (5, "http://x", "", 0),
    ]
    assert sorted(found, key=str) == sorted(wanted, key=str)
    assert wrappers.extract(frame.where("false")).collect() == []


# Product codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """Every distance, with whole numbers of any size."""
    whole = [(i, [int(np.floor(256 * np.float64(x))) for x in v], label) for i, v, label in rows]
    width = len(whole[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(whole, key=lambda r: (r[0], r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def assigned():
        found = []
        for _, v, _ in whole:
            row = []
            for p in range(parts):
                far = [sum((x - y) ** 2 for x, y in zip(cut(v, p), e)) for e in books[p]]
                row.append((far.index(min(far)), min(far)))
            found.append(row)
        return found

    for _ in range(rounds):
        rows_of = assigned()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v, p) for (_, v, _), row in zip(whole, rows_of) if row[p][0] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    found = assigned()
    errors = [sum(d for _, d in row) for row in found]
    per_label = {}
    for (_, _, label), e in zip(whole, errors):
        per_label[label] = per_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return [
        (i, "".join(f"{k:02x}" for k, _ in row), e, per_label[label], digest)
        for (i, _, label), row, e in zip(whole, found, errors)
    ]


def codes_of(frame):
    columns = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in product_codes.compress(frame).select(*columns).collect()), key=str)


def test_codes_against_all_distances(spark):
    draw = np.random.default_rng(3)
    rows = [(int(n), (draw.integers(-3, 4, 32) / 256).tolist(), int(n) % 5 or None) for n in draw.permutation(300)]
    rows += [(5, rows[0][1], 1), (5, rows[0][1], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(7)
    assert codes_of(frame) == sorted(plain_codes(rows), key=str)


def test_search_ends_only_where_no_entry_can_win():
    draw = np.random.default_rng(1)
    for width, spread in ((1, 3), (4, 2), (4, 1000), (16, 1 << 24)):
        entries = draw.integers(-spread, spread + 1, (16, 64, width))
        vectors = draw.integers(-spread, spread + 1, (200, 16 * width))
        index, distance = product_codes.Codebook(entries).nearest(vectors)
        gaps = vectors.reshape(200, 16, 1, width) - entries[None]
        wanted = (gaps * gaps).sum(axis=3)
        assert (distance == wanted.min(axis=2)).all() and (index == wanted.argmin(axis=2)).all()


def test_codes_odd(spark):
    ones, big = [0.5] * 16, [1e30] + [0.0] * 15
    rows = [
        (3, ones, None, 1), (3, ones, None, 1), (None, [0.25] * 16, None, 1), (1, None, 1, 1), (2, [None] * 16, 1, 1), (4, [float("nan")] * 16, 1, 1),
        (5, [float("-inf")] * 16, 1, 1), (6, [1.0] * 17, 2, 1), (7, [], 2, 1), (8, big, 2, 1), (0, [1.0] * 7, 2, 1),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, error int")
    found = codes_of(frame)
    assert [r[:4] for r in found if r[1] is None] == [(0, None, None, None), (6, None, None, None), (7, None, None, None), (8, None, None, None)]
    assert sorted((r[:4] for r in found if r[1]), key=str) == [(3, "00" * 16, 0, 0), (3, "00" * 16, 0, 0), (None, "02" * 16, 0, 0)]
    assert codes_of(frame.where("false")) == [] and len(codes_of(frame.where("vec_id = 7"))) == 1
    wide = spark.createDataFrame([(1, ones, 1, 1), (2, [-x for x in ones], 1, 2)], "vec_id long, embedding array<double>, label int, code int")
    assert [r[1] for r in codes_of(wide)] == ["00" * 16, "01" * 16]


# Filter audit


def plain_audit(docs, labels):
    docs = [(i, s or "", t or "") for i, s, t in docs]
    first = {}
    for i, _, t in docs:
        if i is not None:
            first[t] = min(first.get(t, i), i)
    good, toxic = ({i for i, *marks in labels if i is not None and marks[at] == 1} for at in (0, 1))

    def fails(i, t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        found = "A" if len(words) < 200 else ""
        found += "B" if 100 * len(set(words)) < 50 * len(words) else ""
        found += "C" if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else ""
        found += "D" if re.search("[#$%&*|]", t) else ""
        return found + ("E" if i is not None and i > first[t] else "")

    rows = []
    for part in {s for _, s, _ in docs}:
        mine = [(i, fails(i, t)) for i, s, t in docs if s == part]
        made, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [(i, m) for i, m in left if f in m]
                left = [(i, m) for i, m in left if f not in m]
                shapley[f] += len(gone)
                made.append((
                    part, "".join(order), step, len(left), len(gone), sum(f in m for _, m in mine) - len(gone), sum(m == f for _, m in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), f,
                ))
        rows += [(*r[:9], shapley[r[9]]) for r in made]
    return rows


def test_intervals_cover_each_order_once():
    for mask in range(1, 32):
        covered = sorted(r for m, _, start, stop in filter_audit.intervals() if m == mask for r in range(start, stop))
        assert covered == list(range(120))


def test_audit_against_all_orders(spark, sf_dir, odd_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    marks = [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()]
    found = filter_audit.audit(docs, labels)
    wanted = plain_audit([tuple(r) for r in docs.select("doc_id", "source", "text").collect()], marks)
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    odd = odd_docs.withColumn("part", odd_docs["doc_id"]).withColumn("mask", odd_docs["text"])
    odd = odd.union(odd.where("doc_id = 4").withColumn("source", odd["lang"].substr(9, 1)).withColumn("text", odd["text"]))
    marks = [(1, 1, 1), (1, 0, 0), (None, 1, 1), (4, None, 1), (5, 1, None), (99, 1, 1)]
    frame = spark.createDataFrame([(*m, "x") for m in marks], "doc_id long, quality int, toxic int, part string")
    wanted = plain_audit([tuple(r) for r in odd.select("doc_id", "source", "text").collect()], marks)
    assert sorted(map(tuple, filter_audit.audit(odd, frame).collect())) == sorted(wanted)
    assert filter_audit.audit(odd.where("false"), frame).collect() == []
    assert filter_audit.audit(odd, frame.where("false")).count() == len(wanted)
