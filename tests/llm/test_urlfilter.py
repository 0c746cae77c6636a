import re

from ledgerlens.llm.queries_op5 import BASE, BLOCKED_WORDS, RULES
from ledgerlens.llm.urlfilter import judge

URLS = [
    None, "", "no scheme", "://", "http://", "http://ORG", "http://org/", "http://a.ORG/x?y://z", "http://example.org/es/", "http://example.org/es",
    "https://sub.example.org/en/123", "https://notexample.org/en/1", "http://x.com/fr/1#a", "http://x.com/de/", "http://com/de/9", "http://x.com/DE/9",
    "http://spam-farm.example.net/", "http://spam-farmx.net/", "http://Casino.net/", "ftp://x.com?/de/", "http://é.com/de/ü", "http://u:p@x.com:80/de/1", "a://b://c.org/", "http://x\ny.org/\n", "http://example.org/en/1",
]


def brute(url):
    url = url or ""
    host, path = "", ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(raw):], maxsplit=1)[0]
        host = "".join(c.lower() if c.isascii() else c for c in raw)
    fits = [(len(h + p), h + p, v) for v, h, p in BASE if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    bad = re.search(rf"(?:^|[^a-z0-9])(?:{'|'.join(BLOCKED_WORDS)})(?:$|[^a-z0-9])", (host + path).lower())
    return host, path, None, "block" if bad else "allow"


def test_against_brute_force(spark):
    rows = [(i if i % 5 else None, u, "old") for i, u in enumerate(URLS * 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = judge(df, RULES, keep=["page_id", "url"]).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(key((r.page_id, r.url, r.host, r.path, r.rule, r.verdict)) for r in got) == sorted(key((i, u, *brute(u))) for i, u, _ in rows)


def test_empty_table_and_no_rules(spark):
    df = spark.createDataFrame([(1, "http://x.org/")], "page_id long, url string")
    assert judge(df.limit(0), RULES).count() == 0
    assert [(r.rule, r.verdict) for r in judge(df, []).collect()] == [(None, "allow")]
