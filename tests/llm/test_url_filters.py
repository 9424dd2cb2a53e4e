"""The temporal join against a replay of the list's history."""

import random
from datetime import datetime, timedelta

from duewatch.llm.url_filters import evaluated

ENTRY = "list string, kind string, value string, action string, at timestamp_ntz"
CAPTURE = "page_id long, url string, fetched timestamp_ntz, value int"


def replay(url, fetched, entries):
    rest = url.split("//", 1)[1].split("?")[0].split("#")[0]
    host, slash, path = rest.partition("/")
    host = host.split("@")[-1].split(":")[0].lower()
    path = slash + path or "/"
    active = []
    for key in {e[:3] for e in entries}:
        past = sorted((e[4], e[3]) for e in entries if e[:3] == key and e[4] <= fetched)
        if past and past[-1][1] == "add":
            listed, kind, value = key
            if kind == "domain" and (host == value or host.endswith("." + value)):
                active.append(key)
            if kind == "path" and (host + path == value or value.endswith("/") and (host + path).startswith(value)):
                active.append(key)
    return sum(k[0] == "block" for k in active), sum(k[0] == "allow" for k in active)


def test_random_histories(spark):
    rng = random.Random(6)
    start = datetime(2024, 1, 1)
    hosts = ["a.example.com", "b.example.com", "example.com", "other.org", "hot.net"]
    values = [("domain", h) for h in [*hosts, "com"]] + [("path", f"{h}/x/") for h in hosts] + [("path", "hot.net/x/y.html"), ("path", "hot.net/")]
    entries = list({
        (rng.choice(["block", "block", "allow"]), *rng.choice(values), rng.choice(["add", "add", "remove"]), start + timedelta(days=rng.randrange(30)))
        for _ in range(150)
    })
    captures = []
    for k in range(400):
        host = "hot.net" if k % 3 == 0 else rng.choice(hosts)
        path = rng.choice(["", "/", "/x", "/x/", "/x/y.html", "/z?q=/x/", "/x/y.html#f"])
        captures.append((k, f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(['', 'u:p@'])}{host.upper()}{rng.choice(['', ':8080'])}{path}", start + timedelta(days=rng.randrange(32)), 0))
    found = evaluated(spark.createDataFrame(captures, CAPTURE).repartition(5), spark.createDataFrame(entries, ENTRY)).collect()
    assert len(found) == len(captures)
    by_id = {r.page_id: r for r in found}
    for page, url, fetched, _ in captures:
        block, allow = replay(url, fetched, entries)
        r = by_id[page]
        assert (r.n_block, r.n_allow, r.blocked) == (block, allow, block > 0 and allow == 0), (url, fetched)
        assert (r.rule is None) == (block + allow == 0)


def test_odd_rows(spark):
    day = datetime(2024, 1, 1)
    entries = [("block", "domain", "a.com", "add", day), ("block", "domain", "a.com", "remove", day), ("block", "domain", "b.com", "add", day),
               ("block", "domain", "b.com", "add", day), (None, "domain", "c.com", "add", day), ("block", "domain", None, "add", day)]
    captures = [(1, "http://a.com/", day, 0), (2, "http://b.com/", day, 0), (2, "http://b.com/", day, 0), (3, None, day, 0),
                (4, "http://b.com/", None, 0), (5, "no url", day, 0), (None, "http://b.com/" + "p/" * 500, day, 0), (6, "http://c.com", day, 0)]
    frame = spark.createDataFrame(captures, CAPTURE)
    found = {r.page_id: r for r in evaluated(frame, spark.createDataFrame(entries, ENTRY)).collect()}
    assert {k for k, r in found.items() if r.blocked} == {2, None} and found[2].captures == 2 and len(found) == 7
    assert evaluated(frame.limit(0), spark.createDataFrame(entries, ENTRY)).collect() == []
    assert not any(r.blocked for r in evaluated(frame, spark.createDataFrame([], ENTRY)).collect())
