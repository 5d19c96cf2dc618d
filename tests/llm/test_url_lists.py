import datetime as dt
import random

from barloom.llm.url_lists import allowed, listed, rule_keys, validity


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def state(entries, rule, at):
    """Whether ``rule`` holds on a day: its last entry at or before it, removals last within a day."""
    own = sorted((d, a == "remove") for _, r, a, d in entries if r == rule and d is not None and d <= at and a in ("add", "remove"))
    return bool(own) and not own[-1][1]


def test_against_plain_lookup(spark):
    rng = random.Random(1)
    hosts = ["a.com", "www.a.com", "b.org", "x.b.org", "hot.net"]
    rules = [f"domain:{h}" for h in (*hosts, "com", "net")] + ["prefix:a.com/p", "prefix:a.com/p/q", "prefix:hot.net"]
    entries = [("l", rng.choice(rules), rng.choice(["add", "remove"]), day(rng.randrange(300))) for _ in range(120)]
    entries += [("l", None, "add", day(1)), ("l", "domain:a.com", None, day(1)), ("l", "domain:a.com", "add", None)]
    pages = [(i, f"https://{rng.choice([*hosts, 'hot.net', 'HOT.net'])}:80/p/{rng.choice('qr')}?z#f", day(rng.randrange(400))) for i in range(200)]
    pages += [(900, None, day(3)), (901, "not a url", day(3)), (902, "http://a.com", None), (903, "http://a.com", day(50)), (903, "http://a.com", day(50))]
    table = spark.createDataFrame(entries, "list string, rule string, action string, day date")
    captures = spark.createDataFrame(pages, "page_id long, url string, fetched date")
    keys = {r.url: r.k for r in captures.filter("url is not null").select("url", rule_keys(captures.url).alias("k")).collect()}
    got = listed(captures, table).collect()
    assert len(got) == len(pages)
    for r in got:
        want = sorted({k for k in keys.get(r.url, []) if r.fetched and state(entries, k, r.fetched)})
        assert [x.rule for x in r.listed] == want
    assert sorted(r.page_id for r in allowed(captures, table).collect()) == sorted(r.page_id for r in got if not r.listed)


def test_intervals(spark):
    rows = [("l", "r", a, day(d)) for a, d in (("remove", 1), ("add", 5), ("add", 7), ("remove", 9), ("add", 9), ("add", 20))]
    got = validity(spark.createDataFrame(rows, "list string, rule string, action string, day date")).orderBy("since").collect()
    assert [(r.since, r.until) for r in got] == [(day(5), day(9)), (day(20), None)]


def test_edges(spark):
    table = spark.createDataFrame([], "list string, rule string, action string, day date")
    none = spark.createDataFrame([], "url string, fetched date")
    assert listed(none, table).count() == 0
    clash = spark.createDataFrame([("http://a.com/x", day(1), 3, 4)], "url string, fetched date, rule int, u int")
    assert listed(clash, table).collect() == [("http://a.com/x", day(1), 3, 4, [])]
