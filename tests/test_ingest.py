"""Parsers on the documents of FIXTURES.md section 1."""

from pyspark.sql import functions as F

from corpusmap.sources import listings as L
from corpusmap.sources import pages as PG
from corpusmap.sources import responses as R
from corpusmap.sources.manifests import contiguous_pages

REPO_JSON = """{"total_count": 3, "items": [
  {"full_name": "a/one", "description": "first", "stargazers_count": 61000, "topics": ["x", "y"]},
  {"full_name": "b/two", "description": null,    "stargazers_count": 52000, "topics": []},
  {"full_name": "c/3",   "description": "third", "stargazers_count": "n/a",  "topics": ["z", 7]}]}"""

EVENT_JSON = """{"meta": {"total_count": 41, "per_page": 40}, "hackathons": [
  {"url": "https://demo-2026.devpost.com/", "title": "Demo 2026", "submission_period_dates": "Jan 17 - 18, 2026"},
  {"url": "https://own-domain.example/",    "title": "Dropped",   "submission_period_dates": "2025"},
  {"url": "https://old.devpost.com/",       "title": null,        "submission_period_dates": "TBA"}]}"""

GALLERY = """<div data-software-id="11"><a href="https://devpost.com/software/alpha">
<h5> Alpha &amp; co </h5><p class="small tagline"> <b>fast</b> </p><img class="winner">
<span data-url="https://devpost.com/ann"></span><span data-url="https://devpost.com/bob"></span>
<span data-count="like"> 1,024 </span></a></div>
<div data-software-id="12"><p>no link</p></div>
<div data-software-id="13"><a href="https://devpost.com/software/gamma"><h5>Gamma</h5></a></div>"""

PAGE = """<div id="app-details-left"><h2>Idea</h2><p>One &lt;two&gt;</p><div id="built-with">...</div></div>
<div id="app-details-right"></div>
<div id="submissions"><ul><li><span class="winner label radius">Winner</span> Best Demo </li></ul></div>"""

HEADERS = ("HTTP/2 200 \r\nlink: <https://api.github.com/search/repositories?q=x&page=2>; rel=\"next\", "
           "<https://api.github.com/search/repositories?q=x&page=34>; rel=\"last\"\r\n"
           "X-RateLimit-Remaining: 9\r\nx-ratelimit-reset: 1784646253\r\n")


def test_repo_listing(spark):
    df = spark.createDataFrame([(1, REPO_JSON), (2, '{"total_count": 1}'), (3, '{"items": {"a": 1}}'), (4, "{bad")],
                               "page int, body string")
    rows, rej = L.parse_repo_listing(df, keys=["page"])
    got = [(r.name, r.desc, r.stars, r.topics) for r in rows.orderBy("pos").collect()]
    assert got == [("a/one", "first", 61000, ["x", "y"]), ("b/two", None, 52000, []), ("c/3", "third", 0, ["z"])]
    assert {r.page: r.reject_reason for r in rej.collect()} == {2: "no items array", 3: "no items array",
                                                               4: "not JSON"}


def test_event_listing(spark):
    df = spark.createDataFrame([(1, EVENT_JSON)], "page int, body string")
    hosts, pages, _ = L.parse_event_listing(df, keys=["page"])
    assert [(r.host, r.title, r.year) for r in hosts.orderBy("pos").collect()] == \
        [("demo-2026", "Demo 2026", 2026), ("old", "", 0)]
    p = pages.first()
    assert (p.total_count, p.per_page) == (41, 40)
    from corpusmap.sources.manifests import is_last_page
    lp = spark.createDataFrame([(1,), (2,)], "page int").select(
        is_last_page(F.col("page"), F.lit(40), F.lit(41)).alias("x")).collect()
    assert [r.x for r in lp] == [False, True]


def test_gallery(spark):
    df = spark.createDataFrame([(1, GALLERY)], "page int, html string")
    rows, counts = PG.parse_gallery(df, keys=["page"])
    got = [(r.id, r.slug, r.name, r.tagline, r.likes, r.winner, r.members) for r in rows.orderBy("card").collect()]
    assert got == [(11, "alpha", "Alpha & co", "fast", 1024, True, ["ann", "bob"]),
                   (13, "gamma", "Gamma", None, 0, False, [])]
    assert counts.first().cards == 2


def test_project_page(spark):
    no_built = PAGE.replace('<div id="built-with">...</div>', "")
    no_sub = PAGE.split('<div id="submissions">')[0]
    df = spark.createDataFrame([(1, PAGE), (2, no_built), (3, "<p>nothing</p>"), (4, no_sub)], "i int, html string")
    out = PG.page_prizes(PG.page_writeup(df)).orderBy("i").collect()
    assert out[0].writeup == "Idea\nOne <two>"
    assert out[0].prizes == ["Best Demo"]
    assert out[1].writeup == "Idea\nOne <two>"
    assert out[2].writeup is None
    assert out[3].prizes == []


def test_headers_and_throttle(spark):
    prev_only = "HTTP/2 200\r\nLink: <https://x/?per_page=100&page=3>; rel=\"prev\"\r\n"
    df = spark.createDataFrame([(1, 200, HEADERS, "", 0, 0), (2, 200, prev_only, "", 0, 0),
                                (3, 200, "HTTP/2 200\r\nx-note: link: no\r\n", "", 0, 0),
                                (4, 429, "HTTP/2 429\r\nretry-after: 7\r\n", "", 1, 100),
                                (5, 403, "HTTP/2 403\r\nx-ratelimit-remaining: 0\r\nx-ratelimit-reset: 1000\r\n",
                                 "", 0, 100),
                                (6, 403, "HTTP/2 403\r\n", "API rate limit exceeded", 3, 0),
                                (7, 403, "HTTP/2 403\r\n", "forbidden", 0, 0)],
                               "i int, status int, headers string, body string, attempt int, now long")
    t = R.throttle_plan(df).orderBy("i").collect()
    assert (t[0].page_count, t[0].ratelimit_remaining, t[0].ratelimit_reset) == (34, 9, 1784646253)
    assert t[1].page_count == 4 and t[2].page_count == 1 and t[2].ratelimit_remaining == -1
    assert (t[3].limited, t[3].delay_s) == (True, 7)
    assert (t[4].limited, t[4].delay_s) == (True, 901)
    assert (t[5].limited, t[5].give_up, t[5].delay_s) == (True, True, None)
    assert t[6].limited is False


def test_contiguous_pages(spark):
    rows = [("a", 1, True, 24), ("a", 2, True, 24), ("a", 3, False, 0), ("a", 4, True, 24),
            ("b", 1, True, 24), ("b", 2, True, 0), ("c", 1, True, 5), ("c", 3, True, 5)]
    df = spark.createDataFrame(rows, "host string, page int, ok boolean, cards int")
    keep = {(r.host, r.page): r.kept for r in contiguous_pages(df).collect()}
    assert [keep[("a", p)] for p in (1, 2, 3, 4)] == [True, True, False, False]
    assert [keep[("b", p)] for p in (1, 2)] == [True, False]
    assert [keep[("c", p)] for p in (1, 3)] == [True, False]
    whole = {(r.host, r.page): r.kept for r in contiguous_pages(df, policy="all_or_nothing").collect()}
    assert not whole[("a", 1)] and whole[("b", 1)]


def test_listing_and_search_manifests(spark):
    from corpusmap.sources.manifests import listing_manifest, search_manifest
    first = spark.createDataFrame([(1, 41, 40), ], "page int, total_count long, per_page long")
    pages = [r.page for r in listing_manifest(first).orderBy("page").collect()]
    assert pages == [1, 2]
    served_small = spark.createDataFrame([(1, 41, 20)], "page int, total_count long, per_page long")
    assert listing_manifest(served_small).count() == 3          # the page size served, not the one asked
    names = spark.createDataFrame([("Hack The North",)], "label string")
    url = search_manifest(names).first().url
    assert url.endswith("&search=hack+the+north") and "per_page=40" in url


def test_wait_after_spent_window(spark):
    df = spark.createDataFrame([(1, 200, "HTTP/2 200\r\nx-ratelimit-remaining: 0\r\nx-ratelimit-reset: 150\r\n", "", 0, 100),
                                (2, 200, "HTTP/2 200\r\nx-ratelimit-remaining: 3\r\nx-ratelimit-reset: 150\r\n", "", 0, 100),
                                (3, 404, "HTTP/2 404\r\nx-ratelimit-remaining: 0\r\nx-ratelimit-reset: 150\r\n", "", 0, 100)],
                               "i int, status int, headers string, body string, attempt int, now long")
    got = {r.i: r.wait_s for r in R.throttle_plan(df).collect()}
    assert got == {1: 51, 2: 0, 3: 0}


def test_pass_report(spark):
    from corpusmap.operators.selection import pass_report
    walk = spark.createDataFrame([("a", 1, 24, True), ("a", 2, 0, False), ("b", 1, 5, True)],
                                 "hackathon string, page int, cards long, kept boolean")
    before = spark.createDataFrame([(1, "a", None), (2, "a", [0.1]), (3, "c", None)],
                                   "id long, hackathon string, vector array<float>")
    after = spark.createDataFrame([(1, "a", [0.2]), (2, "a", [0.1]), (3, "c", None)],
                                  "id long, hackathon string, vector array<float>")
    got = {r.hackathon: (r.pages_walked, r.cards_found, r.vectors_written, r.pending_left)
           for r in pass_report(walk, before, after).collect()}
    assert got == {"a": (1, 24, 1, 0), "b": (1, 5, 0, 0), "c": (0, 0, 0, 1)}
