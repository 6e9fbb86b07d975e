from datetime import datetime

from quarry.llm import url_filter as U

from tests.oracle import check


def test_registered_query_agrees_with_sql(spark, sf):
    assert check("op4_url_filter", spark, sf) == 250


def day(s):
    return datetime.fromisoformat(s)


def brute(url, at, events):
    """The deciding entry by trying every pattern at the instant."""
    host = url.split("://")[1].split("/")[0].split("@")[-1].split(":")[0].split("?")[0].lower()
    path = "/" + url.split("://")[1].partition("/")[2].split("?")[0].split("#")[0]
    order = {"remove": 0, "allow": 1, "block": 2}
    best = None
    for pattern in {p for p, *_ in events}:
        past = sorted((day(d), order[a], a) for p, d, a in events if p == pattern and day(d) <= at)
        if not past or past[-1][2] == "remove":
            continue
        eh, slash, ep = pattern.partition("/")
        if (host == eh or host.endswith("." + eh)) and path.startswith(slash + ep):
            best = max(best or (0, 0, ""), (len(eh), len("/" + ep), past[-1][2]))
    return best[2] if best else "pass"


def test_as_of_join_equals_brute_force(spark):
    hosts = ["a.example.com", "b.a.example.com", "example.com", "other.org", "xexample.com"]
    urls = [f"http{s}://{h}{p}" for s in ("", "s") for h in hosts for p in ("", "/", "/en/x?y=1", "/env#t", "/de")]
    events = [("example.com", "2023-01-10", "block"), ("a.example.com", "2023-02-01", "allow"), ("a.example.com", "2023-03-01", "remove"), ("example.com/en", "2023-02-15", "allow"),
              ("example.com", "2023-04-01", "remove"), ("example.com", "2023-05-01", "block"), ("example.com", "2023-05-01", "remove"), ("b.a.example.com/de", "2023-01-20", "block")]
    days = ["2023-01-09", "2023-01-10", "2023-02-14", "2023-02-15", "2023-03-01", "2023-04-02", "2023-06-01"]
    rows = [(i * 100 + k, u, day(d)) for i, u in enumerate(urls) for k, d in enumerate(days)]
    c = spark.createDataFrame(rows, "page_id bigint, url string, fetched timestamp_ntz")
    got = {r.page_id: r.action for r in U.judge(c, spark.createDataFrame(events, "pattern string, day string, action string")).collect()}
    assert got == {i: brute(u, at, events) for i, u, at in rows}
    assert len(set(got.values())) == 3


def test_url_odd(spark):
    t = day("2023-06-01")
    rows = [(1, None, t, "p"), (2, "no url", t, "p"), (3, "http://u:p@Bad.example.com:80/x", t, "p"), (3, "http://bad.example.com/x", t, "p"), (None, "http://bad.example.com", t, None), (5, "http://bad.example.com", None, "p"), (6, "http:///x", t, "p"), (7, "http://bad.example.com/" + "y" * 100000, t, "p")]
    c = spark.createDataFrame(rows, "page_id bigint, url string, fetched timestamp_ntz, URL string")
    events = spark.createDataFrame([("bad.example.com", "2023-01-01", "block")] * 2 + [(None, "2023-01-01", "block"), ("x.org", None, "block"), ("y.org", "2023-01-01", "what")], "pattern string, day string, action string")
    got = [(r.page_id, r.action) for r in U.judge(c, events).collect()]
    assert sorted(got, key=str) == sorted([(1, "pass"), (2, "pass"), (3, "block"), (3, "block"), (None, "block"), (5, "pass"), (6, "pass"), (7, "block")], key=str)
    assert {r.action for r in U.judge(c, events.where("false")).collect()} == {"pass"}
    assert U.judge(c.where("false"), events).count() == 0


def test_case_of_paths_large_ids_and_clashing_columns(spark):
    t = day("2023-06-01")
    rows = [(1, "http://EXAMPLE.com/News/1", t), (2, "http://example.com/news/1", t), (3, "https://sub.Example.COM/News/", t)]
    c = spark.createDataFrame(rows, "page_id bigint, url string, fetched timestamp_ntz")
    events = spark.createDataFrame([("Example.com/News", "2023-01-01", "block")], "pattern string, day string, action string")
    assert {r.page_id: (r.action, r.entry) for r in U.judge(c, events).collect()} == {1: ("block", "example.com/News"), 2: ("pass", None), 3: ("block", "example.com/News")}
    big = [(2**62 + 5, "http://a.example/", "x", "y"), (-3, "http://b.example/", "x", "y"), (None, None, None, None)]
    p = spark.createDataFrame(big, "page_id bigint, url string, URL string, host string")
    got = U.judge(U.captured(p), events).collect()
    assert {r.page_id for r in got} == {2**62 + 5, -3, None} and all(r.action == "pass" for r in got)


def test_hot_hosts_and_suffixes(spark):
    """One host on most captures, one suffix on all, and more entries than captures of most hosts."""
    t = day("2023-06-01")
    rows = [(i, f"http://{'hot' if i % 3 else f'h{i % 50}'}.example.com/p{i % 7}/x", t) for i in range(3000)]
    events = [(f"h{i}.example.com/p{k}", "2023-01-01", "block") for i in range(50) for k in (1, 3)] + [("example.com/p5", "2023-02-01", "block"), ("hot.example.com/p5", "2023-03-01", "allow")]
    got = {r.page_id: r.action for r in U.judge(spark.createDataFrame(rows, "page_id bigint, url string, fetched timestamp_ntz").repartition(6), spark.createDataFrame(events, "pattern string, day string, action string")).collect()}
    assert got == {i: brute(u, at, events) for i, u, at in rows} and set(got.values()) == {"block", "allow", "pass"}
