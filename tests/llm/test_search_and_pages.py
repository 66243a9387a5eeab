"""Top-k search, URL filters and HTML extraction against plain Python; edge rows."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from textlode.llm import extract, topk, urls
from textlode.llm.queries import URL_RULES, page_outcomes


def brute_top_k(rows, queries, k):
    out = []
    for q, v in queries.items():
        found = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in rows if c != q))[:k]
        out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("n", "top", "block"), [(400, 3, 16), (400, 1, 2048), (50, 10**6, 7), (5, 4, 2)])
def test_top_k_equals_brute_force(spark, n, top, block):
    rng = random.Random(n + top)
    rows = [(i, [rng.randint(-top, top) for _ in range(4)]) for i in range(n)]
    queries = {i: v for i, v in rows if i % 5 == 0}
    vectors = spark.createDataFrame(rows, "id bigint, v array<bigint>").repartition(6)
    found = topk.top_k(vectors, vectors.where("id % 5 = 0"), k=10, query_block=block).collect()
    assert sorted(tuple(r) for r in found) == brute_top_k(rows, queries, 10)


def test_most_vectors_alike(spark):
    rows = [(i, [5, 5] if i % 3 else [i, -i]) for i in range(1, 900)]
    vectors = spark.createDataFrame(rows, "id bigint, v array<bigint>").repartition(8)
    found = topk.top_k(vectors, vectors.where("id % 100 = 0")).collect()
    assert sorted(tuple(r) for r in found) == brute_top_k(rows, {i: v for i, v in rows if i % 100 == 0}, 10)


@pytest.mark.parametrize("size", [3 * 10**5, 10**7, 10**8])
def test_large_components_keep_their_last_digits(spark, size):
    """Near ties beyond 2 ** 53, where doubles round."""
    rng = random.Random(size)
    rows = [(i, [size + rng.randint(-2, 2) for _ in range(8)]) for i in range(230)]
    vectors = spark.createDataFrame(rows, "id bigint, v array<bigint>").repartition(4)
    found = topk.top_k(vectors, vectors.where("id % 77 = 0"), k=10).collect()
    assert sorted(tuple(r) for r in found) == brute_top_k(rows, {i: v for i, v in rows if i % 77 == 0}, 10)


def test_scores_beyond_64_bits_raise(spark):
    df = spark.createDataFrame([(0, [2**31, 2**31]), (1, [2**31, 1])], "id bigint, v array<bigint>")
    with pytest.raises(ValueError, match="64-bit"):
        topk.top_k(df, df.where("id = 0")).collect()


def test_unusable_vectors_and_integers(spark):
    rows = [(0, [0.5, -0.0001]), (1, None), (2, [None, 1.0]), (3, [math.nan, 1.0]), (4, [math.inf, 1.0]), (None, [1.0, 1.0]), (5, [1.0, 0.25])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, v string")
    found = {r["id"]: r["v"] for r in topk.as_integers(df).collect()}
    assert found == {0: [512, -1], 5: [1024, 256]}
    assert topk.top_k(topk.as_integers(df), topk.as_integers(df).where("false")).count() == 0
    none = topk.as_integers(df.where("false"))
    assert topk.top_k(none, none).count() == 0


def test_vectors_of_other_lengths_raise(spark):
    df = spark.createDataFrame([(0, [1, 2]), (1, [1, 2, 3])], "id bigint, v array<bigint>")
    with pytest.raises(Exception, match="components"):
        topk.top_k(df, df.where("id = 0")).collect()


URLS = [
    ("http://EXAMPLE.com/en/x?q#f", "example.com", "/en/x", "example.com/en/", "block"),
    ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://a.www.example.com/en/1", "a.www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("https://b.example.com/de/", "b.example.com", "/de/", "com/", "allow"),
    ("https://com", "com", "", None, None),
    ("x://a.net/es/y://b.com/", "a.net", "/es/y://b.com/", "net/es/", "block"),
    ("http://notnet/es/", "notnet", "/es/", None, None),
    ("http://h.net?x=/es/", "h.net", "", None, None),
    ("http://ÄB.org:80#/", "Äb.org:80", "", None, None),
    ("no scheme/com/", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, r[0], "x") for i, r in enumerate(URLS)], "page_id int, url string, host string")
    outcomes = spark.createDataFrame([("h.net", 1)] * 50 + [(None, 1), ("h.net", None)], "host string, good int")
    out = urls.judge(df, outcomes, URL_RULES)
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    for r in out.collect():
        _, host, path, rule, verdict = URLS[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict or (verdict is None and r["verdict"] in ("allow", "block"))
    assert urls.judge(df.where("false"), outcomes, URL_RULES).count() == 0


def test_posteriors_shrink(spark):
    rows = [(f"good{i}.a.org", 1) for i in range(30) for _ in range(20)]
    rows += [("bad.b.net", 0)] * 200 + [("bad2.b.net", 0)] * 100 + [("few.a.org", 0)] * 2
    outcomes = spark.createDataFrame(rows, "host string, good int")
    hosts = spark.createDataFrame([("new.a.org",), ("new.b.net",), ("new.c.com",), ("bad.b.net",)], "host string")
    found = {r["host"]: r for r in urls.host_posteriors(outcomes, hosts).collect()}
    assert found["bad.b.net"]["rate"] < 0.1 and found["good1.a.org"]["bound"] > 0.6
    assert found["few.a.org"]["rate"] > 0.02
    assert found["new.b.net"]["rate"] < found["new.c.com"]["rate"] < found["new.a.org"]["rate"]
    assert all(r["bound"] <= r["rate"] for r in found.values())
    empty = urls.host_posteriors(outcomes.where("false"), hosts).collect()
    assert {r["rate"] for r in empty} == {0.5}


def test_outcomes_of_many_pages_count_as_often(spark):
    hosts = spark.createDataFrame([("a.x.org",), ("b.x.org",)], "host string")
    rows = [("a.x.org", 1, 7), ("a.x.org", 0, 2), ("b.x.org", 0, 5)]
    counted = spark.createDataFrame(rows, "host string, good int, pages bigint")
    each = spark.createDataFrame([(h, g) for h, g, n in rows for _ in range(n)], "host string, good int")
    assert sorted(urls.host_posteriors(counted, hosts).collect()) == sorted(urls.host_posteriors(each, hosts).collect())
    none = urls.judge(hosts.select(F.concat(F.lit("http://"), "host").alias("url")), each.where("false"), [])
    assert {r["verdict"] for r in none.collect()} == {"allow"}


def test_suffixes_are_a_parameter(spark):
    df = spark.createDataFrame([("a.b.or.at",)], "h string")
    got = df.select(urls.domain_of(F.col("h"), ["or.at"]), urls.suffix_of(F.col("h"), ["or.at"]), urls.domain_of(F.col("h"))).first()
    assert tuple(got) == ("b.or.at", "or.at", "or.at")


#: Texts that begin with the same long line, so that only the whole text tells them apart.
OPENING = "the same long opening of every one of these texts goes on for more than sixty characters & has <signs> in it"


def test_outcomes_compare_whole_articles(spark):
    """Openings and headings are alike; what follows decides. Copies, differing labels, nulls and empty texts."""

    def shown(i, text):
        parts = "</p>\n <p>".join(line.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") for line in text.split("\n"))
        return page(f"<h1>{OPENING[:60]}</h1><p>{parts}</p>", '<div class="ad">buy it now please</div>')

    texts = [f"{OPENING}\n" + f"line  {i % 12} of a\u00a0text " * 9 + "\nthe end" for i in range(60)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(60, None), (61, ""), (None, texts[0]), (62, " \n ")]
    # Of each text five copies: those of 0 to 5 are good, of 6 to 11 not; of text 0 a minority is not, of text 1 labels of one copy differ.
    labels = [(i, int(i % 12 < 6), 0) for i in range(60)] + [(12, 0, 0), (24, 1, 1), (1, 0, 0), (60, 0, 0), (61, 0, 0), (62, 0, 0), (None, 0, 0), (2, None, 0)]
    good = {t: int(i % 12 < 6) for i, t in enumerate(texts)}
    pages = [(i, f"http://{'ok' if i % 12 < 6 else 'bad'}.s{i % 12}.org/", shown(i, t)) for i, t in enumerate(texts)]
    pages += [(100, "http://other.org/", shown(0, texts[0] + " and more")), (101, "http://empty.org", None), (102, None, shown(0, texts[7])), (103, "http://empty.org", "")]
    pages += [(104, "http://plain.org/", f"<article><p>{texts[3].replace('&', '&amp;').replace('<', '&lt;')}</p></article>")]
    frames = [
        spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(5),
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
    ]
    found = {(r["host"], r["good"]): r["pages"] for r in page_outcomes(*frames).collect()}
    want = {(f"{'ok' if i < 6 else 'bad'}.s{i}.org", good[texts[i]]): 5 for i in range(12)} | {("", 0): 1, ("plain.org", 1): 1}
    assert found == want
    said = {r["page_id"]: r["verdict"] for r in urls.judge(frames[0], page_outcomes(*frames), [], threshold=0.5).collect()}
    assert all(said[i] == ("allow" if i % 12 < 6 else "block") for i in range(60))
    assert page_outcomes(frames[0].where("false"), *frames[1:]).count() == 0
    assert page_outcomes(frames[0], frames[1].where("false"), frames[2]).count() == 0


def test_registered_domains(spark):
    df = spark.createDataFrame([("a.b.co.uk",), ("a.b.com",), ("com",), ("",)], "h string")
    got = df.select(urls.domain_of(F.col("h")), urls.suffix_of(F.col("h"))).collect()
    assert [tuple(r) for r in got] == [("b.co.uk", "co.uk"), ("b.com", "com"), ("com", "com"), ("", "")]


def page(article, before="", after=""):
    return f"<html><head><title>T &amp; t</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>Home now</a></li></ul></nav>{before}<article>{article}</article>{after}<footer>&copy; all rights</footer></body></html>"


TRAIN = [page(f"<h1>Head {i}</h1>" + "<p>some words of the text here</p>" * (3 + i % 4), '<div class="ad">buy it now please</div>') for i in range(40)]

PAGES = [
    (page("<h1>A&nbsp;title</h1><p>One  two\nthree &lt;4&gt; &amp;amp; five</p><p>b<b>o</b>ld &eacute;</p>"), "A title\nOne two three <4> &amp; five\nbold é"),
    (page("<p><b>open<br><p>second paragraph is here", "<!-- x > y --><script>var a = '</p>';</script>"), "open\nsecond paragraph is here"),
    (
        page("<p>first part of it</p><aside>see also these links</aside><p>second part of it</p>", after='<section id="comments"><p>nice post</p></section>'),
        "first part of it\nsecond part of it",
    ),
    ("<body><div class='cookie-notice'>we use cookies ok</div><div><p>the only words that count here</p></div></body>", "the only words that count here"),
    ("<form><p>search here</p></form>", ""),
    ("<p don't>one isn't</p><p title='a > b'>two</p><p title=\"open>three</p>", "one isn't\ntwo\nthree"),
    ("just text, a < b and no tag", "just text, a < b and no tag"),
    ("<script>never closed", ""),
    ("<", "<"),
    ("", ""),
    (None, ""),
]


def test_pages(spark):
    weights = extract.fit(TRAIN)
    df = spark.createDataFrame([(i, h, "x") for i, (h, _) in enumerate(PAGES)], "page_id int, html string, text string")
    out = extract.extract(df, weights)
    assert out.columns == df.columns
    for r in out.collect():
        assert r["text"] == PAGES[r["page_id"]][1], r["html"]
    assert extract.extract(df.where("false"), weights).count() == 0
    assert extract.weights_of(df.where("false")) == {}


def test_best_region_equals_brute_force():
    rng = random.Random(4)
    weights = {"x": -3.0, "/x": -2.0}
    for _ in range(40):
        parts = [rng.choice(["<x>", "</x>", "a b c", "d", "e f"]) for _ in range(14)]
        text = " ".join(parts)
        row = extract.tokens(text)
        score = [len(t.split()) if k == "#" else weights[k] for k, t, _, _ in row]
        best = max(sum(score[i:j]) for i in range(len(row) + 1) for j in range(i, len(row) + 1))
        got = extract.main_text(text, weights)
        spans = [
            "\n".join(" ".join(t.split()) for k, t, _, _ in row[i:j] if k == "#" and t.strip())
            for i in range(len(row) + 1)
            for j in range(i, len(row) + 1)
            if sum(score[i:j]) == best
        ]
        assert got in spans


def test_long_page_in_linear_time():
    text = page("<p>" + "word " * 200_000 + "</p>" + "<p>x</p>" * 20_000)
    found = extract.main_text(text, extract.fit(TRAIN))
    assert found.count("word") == 200_000 and found.count("\n") == 20_000


def test_query_extracts_articles(spark):
    """The registered query on pages whose article is marked: all of its words, none of the rest."""
    import html
    import re

    from textlode.llm.queries import html_extraction

    folder = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = html_extraction(spark, folder).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r["page_id"]], re.S).group(1)
        assert r["text"].split() == html.unescape(re.sub(r"<[^>]*>", " ", inner)).split()
        assert r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("block", ["<aside>%s</aside>", '<div class="comments">%s</div>', "<nav><ul>%s</ul></nav>"])
def test_long_block_inside_an_article_does_not_cut_it(block):
    weights = extract.fit(TRAIN)
    inner = block % ("<div>see this</div>" * 60)
    text = page("<p>" + "word " * 400 + "</p>" + inner + "<p>" + "last " * 5 + "</p>")
    assert extract.main_text(text, weights).split() == ["word"] * 400 + ["last"] * 5


WORDS = " ".join(f"word{i}" for i in range(60))


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<body class='has-sidebar'><article><p>{WORDS}</p></article></body>", WORDS),
        (f"<body><div class='page with-sidebar'><article><p>{WORDS}</p></article></div></body>", WORDS),
        (f"<body><div class='page sidebar'><article><p>{WORDS}</p></article><div>see this</div></div></body>", WORDS),
        (f"<body><main id='search'><article><p>{WORDS}</p></article></main></body>", WORDS),
        (f"<body><nav><ul><li>Home</li></ul><article><p>{WORDS}</p></article></body>", WORDS),
        (f"<body><form id=all><main><p>{WORDS}</p></main></form></body>", WORDS),
        (f"<body><article><p>{WORDS}</p><p class='share-price'>it rose</p></article></body>", WORDS + "\nit rose"),
        (f"<body><article><p>{WORDS}</p><p class='x share'>tell friends</p><div class='ad-slot'>buy</div></article></body>", WORDS),
        ("<body><article>" + "<section><p>aaa text</p></section>" * 8 + "</article></body>", "\n".join(["aaa text"] * 8)),
        (f"<body><article><p>{WORDS}</p>" + "<div></div>" * 100 + f"<p>{WORDS}</p></article></body>", f"{WORDS}\n{WORDS}"),
        (f"<article><p>{WORDS}</p></article><div class='comments'><article><p>nice post</p></article><article class=comment>hm</article></div>", WORDS),
        (f"<aside><article><p>teaser</p></article></aside><article><p>{WORDS}</p></article>", WORDS),
    ],
)
def test_articles_in_marked_wrappers_stay_whole(html, want):
    plain = [page("<h1>Head</h1>" + "<p>some words of the text here</p>" * 4) for _ in range(20)]
    assert extract.main_text(html, extract.fit(plain)) == want
