from __future__ import annotations

import random

from evidara.llm import url_filter as U


def link(*hosts):
    return "".join(f'<a href="https://{h}/x">l</a>' for h in hosts)


def pages(spark, rows):
    return spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id bigint, url string, html string")


def reversed_shares(links):
    """The reversed edges of links (a, b): n, each as its share of what b gets."""
    got = {}
    for (_, b), n in links.items():
        got[b] = got.get(b, 0) + n
    return {(b, a): n / got[b] for (a, b), n in links.items()}


def plain_scores(seeds, edges, rounds, damping):
    score = {h: (1 - damping) * s for h, s in seeds.items()}
    start = dict(score)
    for _ in range(rounds):
        new = dict(start)
        for (a, b), w in edges.items():
            if a in score:
                new[b] = new.get(b, 0) + damping * score[a] * w
        score = new
    return score


def test_rules_hosts_and_paths(spark):
    rows = [
        ("http://a.org/x", None), ("http://EXAMPLE.org/es/1", None), ("http://www.example.org/en/12?q#z", None), ("http://example.org/en/2", None), ("http://b.com/fr/", None),
        ("http://b.com/de/1", None), ("http://b.com/fr", None), ("http://org/", None), ("http://xorg/", None), ("http://a.org", None), ("no scheme", None), (None, None), ("x://h.org?u=://y.org/", None), ("a://b.com\n/fr/", None),
    ]
    got = {r.page_id: r for r in U.judge(pages(spark, rows)).collect()}
    assert [got[k].rule for k in range(14)] == ["org/", "example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, "org/", None, None, None, None, None, None]
    assert [got[k].verdict for k in range(6)] == ["allow", "block", "block", "allow", "allow", "block"]
    assert (got[1].host, got[1].path) == ("example.org", "/es/1") and (got[2].host, got[2].path) == ("www.example.org", "/en/12")
    assert (got[10].host, got[10].path, got[11].host, got[11].path) == ("", "", "", "") and (got[12].host, got[12].path) == ("h.org", "")
    assert got[13].host == "b.com\n" and len(got) == 14


def test_propagation_equals_a_plain_version(spark):
    rows = [
        ("http://good.org/", link("near.net", "near.net", "mid.net")), ("http://near.net/", link("far.net")), ("http://bad.com/de/1", link("mid.net")),
        ("http://friend.net/", link("bad.com", "bad.com", "far.net")), ("http://far.net/", link("friend.net")), ("http://alone.net/", link("alone.net", "Near.NET")), ("http://mid.net/a", None),
    ]
    got = {r.host: r.verdict for r in U.judge(pages(spark, rows)).where("rule is null").collect()}
    edges = {("good.org", "near.net"): 2 / 3, ("good.org", "mid.net"): 1 / 3, ("near.net", "far.net"): 1, ("bad.com", "mid.net"): 1, ("friend.net", "bad.com"): 2 / 3, ("friend.net", "far.net"): 1 / 3, ("far.net", "friend.net"): 1, ("alone.net", "near.net"): 1}
    links = edges | {("good.org", "near.net"): 2, ("good.org", "mid.net"): 1, ("friend.net", "bad.com"): 2, ("friend.net", "far.net"): 1}
    trust = plain_scores({"good.org": 1}, edges, 200, U.DAMPING)
    distrust = plain_scores({"bad.com": 1}, reversed_shares(links), 200, U.DAMPING)
    assert got == {h: "block" if distrust.get(h, 0) > trust.get(h, 0) else "allow" for h in got}
    assert got["friend.net"] == "block" and got["near.net"] == "allow"


def test_distrust_is_shared_out_among_the_hosts_that_link(spark):
    """Five hosts that link to one blocked host share its score; none is given the whole of it."""
    seeds = spark.createDataFrame([("bad.com", "block", 1)], "host string, verdict string, n bigint")
    links = spark.createDataFrame([(f"p{k}.net", "bad.com", 1) for k in range(5)], "src string, dst string, n bigint")
    got = {r.host: (r.trust, round(r.distrust, 9)) for r in U.scores(seeds, links).collect()}
    assert got == {"bad.com": (0.0, 0.15)} | {f"p{k}.net": (0.0, 0.0255) for k in range(5)}
    assert abs(sum(d for _, d in got.values()) - 0.2775) < 1e-9


def test_the_sql_follows_links_as_well(spark, tmp_path):
    import duckdb

    rng = random.Random(3)
    hosts = [f"h{k}.net" for k in range(25)] + ["good.org", "bad.com"]
    rows = [(f"http://{h}/" + ("de/" if h == "bad.com" else ""), link(*rng.choices(hosts, k=rng.randrange(0, 4)))) for h in hosts for _ in range(2)] + [(None, None), ("x", link("h1.net"))]
    df = pages(spark, rows)
    want = sorted(map(tuple, U.judge(df).collect()))
    assert {v for *_, v in want} == {"allow", "block"} and sorted(map(tuple, U.judge(df, most_sent=0).collect())) == want
    df.write.parquet(str(tmp_path / "p"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/p/*.parquet'")
    cols = "page_id, host, path, rule, verdict"
    assert sorted(con.execute(f"SELECT {cols} FROM ({U.oracle_sql()})").fetchall(), key=lambda r: r[0]) == want


def test_long_urls_and_html(spark):
    html = "<p>x</p>" * 100_000 + link("bad.com")
    got = {r.page_id: r.verdict for r in U.judge(pages(spark, [("http://a.net/" + "y" * 200_000, html), ("http://bad.com/de/", None)])).collect()}
    assert got == {0: "block", 1: "block"}


def test_empty_table_repeats_and_extra_columns(spark):
    df = pages(spark, [("http://a.org/", None)] * 3)
    assert U.judge(df.where("page_id < 0")).collect() == []
    assert U.judge(df.selectExpr("*", "1 as host", "2 as rule", "3 as r").unionByName(df.selectExpr("*", "1 as host", "2 as rule", "3 as r"))).count() == 6


def test_chains_and_cycles_are_followed_to_their_end(spark):
    """A blocked seed nine links away, and a cycle whose verdict turns after many rounds."""
    rows = [(f"http://h{k}.net/", link("bad.com" if k == 9 else f"h{k + 1}.net")) for k in range(1, 10)] + [("http://bad.com/de/1", None)]
    rows += [("http://good.org/", link("c0.net", "x.net", "y.net", "z.net"))] + [(f"http://c{k}.net/", link(f"c{(k + 1) % 8}.net", *["bad.com"] * (k == 7))) for k in range(8)]
    got = {r.host: r.verdict for r in U.judge(pages(spark, rows)).where("rule is null").collect()}
    edges = {(f"h{k}.net", "bad.com" if k == 9 else f"h{k + 1}.net"): 1 for k in range(1, 10)} | {("good.org", h): 1 / 4 for h in ("c0.net", "x.net", "y.net", "z.net")}
    edges |= {(f"c{k}.net", f"c{k + 1}.net"): 1 for k in range(7)} | {("c7.net", "c0.net"): 1 / 2, ("c7.net", "bad.com"): 1 / 2}
    trust = plain_scores({"good.org": 1}, edges, 400, U.DAMPING)
    back = reversed_shares({e: 1 for e in edges})
    distrust = plain_scores({"bad.com": 1}, back, 400, U.DAMPING)
    assert got == {h: "block" if distrust.get(h, 0) > trust.get(h, 0) else "allow" for h in got}
    assert all(got[f"h{k}.net"] == "block" for k in range(1, 10))
    scores = U.propagate(spark.createDataFrame([("bad.com", 1.0)], "host string, share double"), spark.createDataFrame([(a, b, float(w)) for (a, b), w in back.items()], "src string, dst string, w double"))
    assert all(abs(r.score - distrust[r.host]) < 1e-9 for r in scores.collect()) and scores.count() == len(distrust)
