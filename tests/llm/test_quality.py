"""Rules against plain Python; host verdicts."""

import re
from collections import Counter

import pyarrow as pa

from duewatch.llm.quality import MEASURES, beta_prior, host_rates, judged, kept_rows, measured, measures

TEXTS = [
    None, "", " \n\t", "a b c", "a b c a b c", "x x x x", "A a A a A a", "é # * $% &|<> \x0b y", "l1\nl1\n \n\nl2\nl1\r\nl1\r",
    "one two three four one two three", "w " * 5000, "z" * 50_000, "  a  b\n a b ", "a b c d a b c e b c d",
]


def plain(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))


def test_measures():
    found = measured(pa.array(TEXTS, pa.string()))
    for k, text in enumerate(TEXTS):
        assert tuple(int(found[name][k]) for name in MEASURES) == plain(text), text


def test_hosts(make):
    good, bad = " ".join(f"w{k}" for k in range(60)), "short"
    rows = [(k, good if k % 10 else bad, "fine") for k in range(200)]
    rows += [(1000 + k, bad if k % 10 else good, "poor") for k in range(200)]
    rows += [(2000, bad, "small"), (2001, good, "small"), (2002, good, None), (2003, None, None), (None, good, "fine"), (5, good, "fine"), (5, good, "fine")]
    df = make(rows)
    found = judged(df, "source").collect()
    assert len(found) == len(rows)
    kept = Counter((r.host, r.kept) for r in found)
    assert kept["fine", True] == 183 and kept["poor", True] == 0 and kept["small", True] == 1 and kept[None, True] == 1
    stay = kept_rows(df, "source")
    assert stay.columns == df.columns
    assert sorted(map(repr, stay.select("doc_id", "source").collect())) == sorted(
        repr(r) for r in df.select("doc_id", "source").collect() if (r.source != "poor" and good == dict((x[0], x[1]) for x in rows)[r.doc_id])
    )
    rates = {r.host: r for r in host_rates(measures(df, "source")).collect()}
    assert rates["small"].rate != 0.5 and rates["poor"].rate > 0.8


def test_prior():
    a, b = beta_prior(1000, 100_000, 20_000, 20_000 * 0.2)  # every host at the mean: all noise is explained
    assert a / (a + b) == 0.2 and a + b == 1e6
    assert beta_prior(0, 0, 0, 0.0) == (1.0, 1.0)
    assert beta_prior(3, 30, 0, 0.0)[0] == 0.0


def test_empty(make):
    assert judged(make([]), "source").collect() == []
    assert kept_rows(make([]), "source").collect() == []
