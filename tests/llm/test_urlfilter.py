import random

import pytest

from fluxpanel.llm import urlfilter
from fluxpanel.llm.queries import URL_BLOCKLIST, URL_RULES

URLS = [
    None, "", "no scheme", "http://", "http://ORG", "http://a.org/", "https://X.Example.org/es/1?a=/en/1", "http://example.org/en/1", "http://notexample.org/en/1",
    "https://m.example.org/en/2#://q", "ftp://b.com/fr/x", "http://b.com/de/", "http://b.com/de", "http://www.adult-x.example.com/", "http://adult-x.example.com/fr/",
    "http://u:p@adult-x.example.com:80/x", "://org/x", "http://org?x/", "http://a\nb.com/de/\n?", "HTTP://É.ORG/", "http://org/" + "y" * 5000, "x://y://com/de/",
]


def brute(url, rules, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = lambda h, p: (host == h or host.endswith("." + h)) and path.startswith(p)
    own = sorted(((len(h + p), h + p, v) for h, p, v in rules if fits(h, p)), reverse=True)
    if own:
        return host, path, own[0][1], own[0][2]
    return host, path, None, "block" if any(fits(h, p) for h, p in listed) else "allow"


@pytest.mark.parametrize("max_bytes", [64_000_000, 1])
def test_equals_brute_force(spark, max_bytes):
    rng = random.Random(2)
    hosts = ["a.b.c", "b.c", "c", "x.c"]
    paths = ["", "/", "/p", "/p/q", "/q"]
    rules = list(URL_RULES) + [(h, p, rng.choice(["allow", "block"])) for h in hosts for p in paths if rng.random() < 0.4]
    listed = [(h, "") for h in URL_BLOCKLIST] + [("x.c", "/q")]
    urls = URLS + [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '/', 'z', '?k'])}" for _ in range(200)]
    entries = spark.createDataFrame([(*r, False) for r in rules] + [(*e, "block", True) for e in listed] + [(None, "/", "block", False)], urlfilter.ENTRY)
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(None, URLS[5], "clash")], "page_id long, url string, host string")
    out = urlfilter.judge(pages, entries, max_bytes=max_bytes)
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    rows = out.collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        assert tuple(r)[2:] == brute(r.url, rules, listed), r.url
    assert urlfilter.judge(pages.limit(0), entries, max_bytes=max_bytes).count() == 0
    assert {r.verdict for r in urlfilter.judge(pages, entries.limit(0), max_bytes=max_bytes).collect()} == {"allow"}


def test_colliding_digests_are_told_apart(monkeypatch):
    monkeypatch.setattr(urlfilter.DigestIndex, "digest", staticmethod(lambda e: len(e)))
    index = urlfilter.DigestIndex.mapped(urlfilter.DigestIndex.build([b"aa", b"bb", b"c", b"dd"], [1, 2, 3, 4]))
    at = index.probe([b"bb", b"dd", b"xx", b"c", b"d", b"eeee"])
    assert [int(index.values[i]) if i >= 0 else None for i in at] == [2, 4, None, 3, None, None]
