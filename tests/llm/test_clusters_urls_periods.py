"""Centroid clustering, URL filters and periodic runs: brute force, defined cases and bounds."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from strata.llm import clusters, periods, urls

NAN, INF = float("nan"), float("inf")


# --- centroid clustering ---


def brute_lloyd(rows, k, rounds, dims, scale=64):
    good = [(i, [math.floor(scale * x) if abs(x) < 2**53 else int(x) * scale for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: ((1, "") if r[0] is None else (0, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest()), r[1])
    centers = [list(v) for _, v in sorted(good, key=key)[:k]]
    at = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centers))
    for _ in range(rounds):
        mine = defaultdict(list)
        for _, v in good:
            mine[at(v)[1]].append(v)
        centers = [[sum(x) // len(mine[n]) for x in zip(*mine[n], strict=True)] if n in mine else c for n, c in enumerate(centers)]
    out = [(i, *at(v)[::-1]) for i, v in good]
    sums = defaultdict(int)
    for _, c, d in out:
        sums[c] += d
    fits = lambda v: v if v < 2**63 else None
    return sorted(((i, c, fits(d), fits(sums[c]), fits(sum(sums.values()))) for i, c, d in out), key=repr), centers


def vectors(spark, rows, kind="float"):
    x = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return x.withColumns({"id": F.lit(9), "vector": F.lit("v"), "cluster": F.lit("c"), "distance": F.lit(1), "place": F.lit(0), "s": F.lit(0)})


def test_clusters_against_brute_force(spark):
    r = random.Random(3)
    rows = [(i, [r.randrange(-40, 40) / 16 for _ in range(4)]) for i in range(60)]
    rows += [(7, rows[7][1]), (None, [0.5, 1.0, -1.0, 2.0]), (None, [0.25] * 4), (70, None), (71, []), (72, [1.0] * 3), (73, [1.0, None, 1.0, 1.0]), (74, [1.0, NAN, 1.0, 1.0]), (75, [INF] * 4), (76, [1.0] * 5)]
    for k in (3, 16, 100):
        got, centers = clusters.lloyd(vectors(spark, rows).repartition(5), k=k, dims=4)
        want, held = brute_lloyd(rows, k, 3, 4)
        assert centers == held
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_clusters_of_equal_and_no_vectors(spark):
    got, centers = clusters.lloyd(vectors(spark, [(i, [0.5, -0.5]) for i in range(40)]), k=4, dims=2)
    assert {(r.cluster, r.distance, r.inertia) for r in got.collect()} == {(0, 0, 0)} and len(centers) == 4  # ties go to the smaller number
    got, centers = clusters.lloyd(vectors(spark, [(1, None), (2, [1.0])]), k=4, dims=2)
    assert got.collect() == [] and centers == []
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia"]


def test_clusters_of_huge_components(spark):
    """Sums and differences beyond 64 bits stay exact; what does not fit a long is null."""
    rows = [(1, [1e30, 1.0]), (2, [1e30, 3.0]), (3, [-1e30, 1.0]), (4, [1e300, 0.0]), (5, [0.015625, 1e9]), (6, [0.0, 1e9]), (7, [3e7, -3e7])]
    for k in (2, 7):
        got, centers = clusters.lloyd(vectors(spark, rows, "double").repartition(3), k=k, dims=2)
        want, held = brute_lloyd(rows, k, 3, 2)
        assert centers == held and sorted(map(tuple, got.collect()), key=repr) == want


def test_digits():
    for v in (0, 1, -1, 1 << 40, -(1 << 40) - 5, 3**100, -(3**100)):
        assert sum(d << (clusters.DIGIT * i) for i, d in enumerate(clusters.digits(v))) == v


# --- URL filters ---


def test_url_parts_and_rules(spark):
    rows = [
        ("http://A.Example.NET/en/x", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://example.net?x=/en/", "example.net", "", None, None),
        ("https://b.net/#a", "b.net", "/", "net/", "block"),
        ("x://notexample.com/de/", "notexample.com", "/de/", None, None),
        ("x://EXAMPLE.com/de/1?a://b", "example.com", "/de/1", "example.com/de/", "block"),
        ("ftp://u@h.org:8/fr/", "u@h.org:8", "/fr/", None, None),
        ("h.org/fr/", "", "", None, None), ("", "", "", None, None), (None, "", "", None, None), ("://", "", "", None, None),
        ("a\nb://x.org/fr/\n?", "x.org", "/fr/\n", "org/fr/", "allow"),
        ("http://ÄB.org/fr/" + "x" * 100_000, "Äb.org", "/fr/" + "x" * 100_000, "org/fr/", "allow"),
    ]
    x = urls.judged(spark.createDataFrame([(r[0],) for r in rows], "url string"))
    got = sorted(((r.url, r.host, r.path, r.rule, r.verdict) for r in x.collect()), key=repr)
    assert got == sorted(rows, key=repr)


def brute_rank(seeds, edges, rounds=8, keep=85):
    out, rank = defaultdict(set), dict(seeds)
    for a, b in edges:
        out[a].add(b)
    for _ in range(rounds):
        after = {h: m // 100 * (100 - keep) for h, m in seeds.items()}
        for h, m in rank.items():
            for t in out[h]:
                after[t] = after.get(t, 0) + m // len(out[h]) * keep // 100
        rank = after
    return {h: m for h, m in rank.items() if m}


def test_spread_against_brute_force(spark):
    r = random.Random(2)
    edges = {(f"h{r.randrange(30)}", f"h{r.randrange(30)}") for _ in range(90)} | {("hub", f"h{i}") for i in range(30)} | {(f"h{i}", "hub") for i in range(0, 30, 3)}
    edges = {(a, b) for a, b in edges if a != b}
    seeds = {("t", f"h{i}"): (i + 1) * 1_000_000 for i in range(4)} | {("d", "hub"): 3_000_003}
    e = spark.createDataFrame([(k, *x) for k in "td" for x in edges], "kind string, src string, dst string")
    s = spark.createDataFrame([(*k, m) for k, m in seeds.items()], "kind string, host string, mass long")
    for part in (10_000, 4):  # a host's edges in one part, and in several
        got = {(x.kind, x.host): x.mass for x in urls.spread(s, e, part_edges=part).collect() if x.mass}
        assert got == {(k, h): m for k in "td" for h, m in brute_rank({h: m for (kk, h), m in seeds.items() if kk == k}, edges).items()}


def link(*hosts):
    return "".join(f'<A class=x HREF = "https://{h}/a?b">x</a><a href=\'/local\'>y</a>' for h in hosts)


def test_trust_and_distrust_over_links(spark):
    """Who links to a bad host is suspect; who is linked from a good one is trusted; both across some hosts."""
    rows = [
        (1, "http://bad.net/x", link("worse.io")), (2, "http://bad.net/y", ""), (3, "http://friend.io/1", link("BAD.net")), (4, "http://accomplice.io/", link("friend.io")),
        (5, "http://good.org/fr/1", link("shop.io", "bad.net")), (6, "http://shop.io/", link("friend.io", "shop.io")), (7, "http://worse.io/", None), (8, "http://alone.io/", "<a href=//x"),
        (9, None, link("bad.net")), (10, "nothing", None), (None, "http://friend.io/1", ""), (3, "http://friend.io/1", link("BAD.net")),
        (11, "http://big.example.com/de/", ""), (12, "http://big.example.com/en/", ""), (13, "http://big.example.com/es/", ""), (14, "http://sub.big.example.com/it/", "z" * 200_000),
    ]
    rows += [(20 + i, f"http://bad.net/{i}", "") for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"pages": F.lit(1), "mass": F.lit("m"), "kind": F.lit(0), "blocked": F.lit(1), "trust": F.lit(2)})
    got = urls.filter_urls(pages.select("page_id", "url"), html=pages)
    verdicts = {(r.page_id, r.url): (r.rule, r.verdict) for r in got.collect()}
    assert got.count() == len(rows)
    by_url = {u: v for (_, u), v in verdicts.items()}
    assert by_url["http://bad.net/x"] == ("net/", "block") and by_url["http://good.org/fr/1"] == ("org/fr/", "allow")
    assert by_url["http://big.example.com/de/"] == ("example.com/de/", "block")
    hosts = {r.host: r for r in urls.host_verdicts(pages).collect()}
    edges = {("bad.net", "worse.io"), ("friend.io", "bad.net"), ("accomplice.io", "friend.io"), ("good.org", "shop.io"), ("good.org", "bad.net"), ("shop.io", "friend.io"), ("sub.big.example.com", "big.example.com"), ("big.example.com", "sub.big.example.com")}
    trust = brute_rank({"good.org": 1_000_000}, edges)
    distrust = brute_rank({"bad.net": 8_000_000, "big.example.com": 1_000_000}, [(b, a) for a, b in edges])
    pages_of = {"friend.io": 3, "bad.net": 8, "big.example.com": 3}
    assert set(hosts) == {"bad.net", "friend.io", "accomplice.io", "good.org", "shop.io", "worse.io", "alone.io", "big.example.com", "sub.big.example.com"}
    for h, r in hosts.items():
        assert (r.trust, r.distrust) == (trust.get(h, 0), distrust.get(h, 0)), h
        assert r.blocked == (r.distrust > r.trust and r.distrust > pages_of.get(h, 1) * 150_000 * 50 // 100), h
    assert by_url["http://friend.io/1"][1] == "block" and by_url["http://shop.io/"] == (None, "allow" if not hosts["shop.io"].blocked else "block")
    assert by_url["http://alone.io/"] == by_url["http://worse.io/"] == by_url["nothing"] == by_url[None] == (None, "allow")
    assert pages.where("false").transform(lambda x: urls.filter_urls(x.select("page_id", "url"), html=x)).collect() == []


def test_url_filter_keeps_html_out_of_the_join(spark):
    plan = urls.op12_url_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan and not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct"))


# --- periodic runs ---


def brute_runs(w):
    n, out = len(w), []
    for d in range(1, n // 4 + 1):
        i = 0
        while i < n - d:
            j = i
            while j < n - d and w[j] == w[j + d]:
                j += 1
            length = j - i + d
            if j > i and length >= max(6, 4 * d) and not any(all(w[k] == w[k + q] for k in range(i, i + length - q)) for q in range(1, d)):
                out.append((i, length, d))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(r, n):
    size = r.choice((1, 2, 2, 3, 5))
    words = []
    while len(words) < n:
        base = [r.randrange(size) for _ in range(r.randrange(1, 30))]
        words += (base * r.randrange(1, 9))[: r.randrange(1, 150)] + [r.randrange(size) for _ in range(r.randrange(3))]
    return words[:n]


def test_runs_against_brute_force(monkeypatch):
    r = random.Random(4)
    for segment in (1 << 11, 8):  # whole texts and many segments
        monkeypatch.setattr(periods, "SEGMENT", segment)
        for _ in range(1500):
            w = random_words(r, r.randrange(0, 260))
            assert periods.runs_of(np.array(w, np.int64)) == brute_runs(w), w


def test_runs_of_large_texts_in_bounded_time():
    n = 300_000
    assert periods.runs_of(np.zeros(n, np.int64)) == [(0, n, 1)]
    assert periods.runs_of(np.tile(np.arange(n // 5), 5)) == [(0, n, n // 5)]
    a = np.tile(np.array([0] * 600 + [1]), 100)
    assert periods.runs_of(a)[0] == (0, 600, 1) and (0, len(a), 601) in periods.runs_of(a)
    assert periods.runs_of(np.arange(n)) == []


def planted(doc_id, text):
    w = text.encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_periodic_runs_rows(spark, tmp_path):
    """The whole query against brute force, with documents that repeat and odd ones."""
    r = random.Random(6)
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:25] + list(range(20))
    rows = [(i, " ".join(f"w{x}" for x in random_words(r, r.randrange(0, 120)))) for i in ids]
    rows += [(i, " ".join(f"w{r.randrange(50)}" for _ in range(90))) for i in ids]
    zero = next(i for i in range(400, 900) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows += [(zero, ""), (zero, None), (zero, " \t\n\x0b\x0c\r"), (zero, "one"), (None, None), (None, "a " * 30), (500_000, "a\u00a0b \u2003 " * 9), (-3, "x y " * 40_000), (1, "x\ty\r\n" * 4), (1, "x\ty\r\n" * 4)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d, t in rows:
        w = planted(d, t or "")
        runs = brute_runs(w) if len(w) < 1000 else [(0, len(w), 2)]
        drop = {i for s, length, q in runs for i in range(s + q, s + length)}
        top = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        want.append((d, len(runs), *best, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in drop))))
    got = periods.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(x[1] for x in want) > 60


def test_periodic_runs_keeps_columns(spark):
    x = spark.createDataFrame([(1, "a a a a a a b", "r")], "doc_id long, text string, runs string").withColumns({"__id": F.lit(3), "collapsed": F.lit(4), "n_runs": F.array(F.lit(1))})
    row = periods.periodic_runs(x).first()
    assert row.asDict(True) == {"doc_id": 1, "__id": 3, "n_runs": [1], "runs": [{"start": 0, "length": 6, "period": 1}], "collapsed": "a b"}
    assert periods.periodic_runs(x.where("false")).collect() == []
