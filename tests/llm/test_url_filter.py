import math
from collections import Counter, defaultdict

from almanac.llm import url_filter as U


def split(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    end = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return host, path[:end]


def ruled(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute(urls):
    """The verdicts by a plain model."""
    code = lambda c: 0 if c not in U.LETTERS else U.LETTERS.index(c) + 2
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else "0" if c in "123456789" else c for c in s)
    rows = []
    for u in urls:
        host, path = split(u)
        s = [1, 1, *map(code, lower(host + path))]
        rows.append((host, path, *ruled(host, path), [tuple(s[i - 2 : i + 1]) for i in range(2, len(s))]))
    n = {v: [Counter(), Counter(), Counter()] for v in ("allow", "block")}
    for *_, verdict, grams in rows:
        if verdict:
            for g in grams:
                for k in range(3):
                    n[verdict][k][g[2 - k :]] += 1
    totals = {v: [defaultdict(lambda: [0, 0]) for _ in range(3)] for v in n}
    for v in n:
        for k in range(3):
            for g, c in n[v][k].items():
                totals[v][k][g[:-1]][0] += c
                totals[v][k][g[:-1]][1] += 1

    def p(v, g):
        out = (n[v][0][g[2:]] + 1) / (totals[v][0][()][0] + U.SYMBOLS)
        for k in (1, 2):
            s, t = totals[v][k].get(g[2 - k : 2], (0, 0))
            if s + t:
                out = (n[v][k][g[2 - k :]] + t * out) / (s + t)
        return out

    ratio = lambda g: round((math.log(p("allow", g)) - math.log(p("block", g))) * U.UNIT)
    mean = [math.floor(sum(map(ratio, r[4])) / len(r[4])) if r[4] else 0 for r in rows]
    by = {v: [m for m, r in zip(mean, rows, strict=True) if r[3] == v] for v in n}
    threshold = math.floor(sum(sum(x) / len(x) for x in by.values()) / 2) if all(by.values()) else 0
    return [(r[0], r[1], r[2], r[3] or ("allow" if m >= threshold else "block")) for r, m in zip(rows, mean, strict=True)]


URLS = [
    *[f"https://a{i}.Example.com/{x}/p{i}?q=1" for i in range(30) for x in ("en", "fr")], *[f"http://b{i}.net/es/{i}#t" for i in range(20)], *[f"http://b{i}.net/fr/{i}" for i in range(20)],
    *[f"http://news{i}.org/story/{i}" for i in range(10)], "https://www.example.com/en/x", "http://com/", "http://com", "com/", None, "", "x://", "ftp://u@H.Com:80/é/?a", "http://example.com/en", "//no", "http://net/es/", "http://net/es",
    "http://q.org/" + "long/" * 5000,
]


def test_against_a_plain_model(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(None, "http://a.com/z", None), (0, URLS[0], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    out = U.judge(df).collect()
    want = dict(zip(range(len(URLS)), brute([*URLS, "http://a.com/z", URLS[0]]), strict=False))
    assert len(out) == len(rows)
    for r in out:
        if r["page_id"] is not None:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == want[r["page_id"]]


def test_rules(spark):
    df = spark.createDataFrame([(1, "http://www.example.com/en/a"), (2, "http://example.com/en/a"), (3, "http://example.com/de"), (4, "http://notexample.com/en/"), (5, "http://x.net/es/")], "page_id int, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in U.judge(df).collect()}
    assert got == {1: ("www.example.com/en/", "allow"), 2: ("example.com/en/", "block"), 3: ("com/", "allow"), 4: ("com/", "allow"), 5: ("net/es/", "block")}


def test_empty_and_unlabelled(spark):
    df = spark.createDataFrame([(1, "http://a.org/x")], "page_id int, url string")
    assert U.judge(df.limit(0)).count() == 0
    assert U.judge(df).collect()[0]["verdict"] in ("allow", "block")


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "http://a.com/x")], "page_id int, url string")
    plan = U.judge(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
