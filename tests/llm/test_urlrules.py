"""URL filters against plain string rules and all combinations of tokens."""

import itertools
import random
import string

from pyspark.sql import functions as F

from sealwright.llm import urlrules

TESTDATA = "/root/testdata/sf0.001"
CAPITALS = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def _parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = rest[:end].translate(CAPITALS), rest[end:]
    return host, path[:min((path.index(c) for c in "?#" if c in path), default=len(path))]


def _stated(url, rules=urlrules.RULES):
    host, path = _parts(url)
    best = None
    for verdict, rule in rules:
        own, _, rest = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest):
            if best is None or len(rule) > len(best[0]):
                best = (rule, verdict)
    return best


def _verdict(url, tokens, mined):
    """The best of all mined rules, one by one."""
    fits = [m for m in mined if set(m["needs"]) <= set(tokens)]
    if not fits:
        return None, "allow"
    top = min(fits, key=lambda m: (-m["sure"], -m["support"], len(m["needs"]), m["rule"]))
    return top["rule"], top["verdict"]


def _check(spark, pages, labelled=None):
    found = urlrules.filter_urls(pages, labelled).collect()
    urls = [r["url"] for r in pages.select("url").collect()]
    assert len(found) == len(urls)
    seen = labelled if labelled is not None else spark.createDataFrame(
        [(u, _stated(u)[1]) for u in urls if _stated(u)], "url string, verdict string")
    mined = urlrules.mine(seen).collect()
    tokens = {r["url"]: r["t"] for r in pages.select("url", urlrules.url_tokens(F.col("url")).alias("t")).collect()}
    for row in found:
        assert (row["host"], row["path"]) == _parts(row["url"]), row
        stated = _stated(row["url"])
        if stated:
            assert (row["rule"], row["verdict"], row["mined"]) == (*stated, None), row
        else:
            assert row["rule"] is None
            assert (row["mined"], row["verdict"]) == _verdict(row["url"], tokens[row["url"]], mined), row
    return found, mined


def test_driver_table(spark):
    _, mined = _check(spark, spark.read.parquet(f"{TESTDATA}/pages.parquet"))
    assert mined


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "://", "http://", "http://ORG/", "http://org", "http://a.org?x=1", "http://a.org#f", "http://xorg/",
            "http://m.Example.ORG/en/1x", "http://example.org/en/2", "http://example.org/EN/1", "http://example.org/es", "http://example.com/de/?q",
            "http://com/fr/a/b.html?x=1&y=2#z", "ftp://a.b.c.d.e.com/fr/://x/de/", "http://Ä.org/中", "http://a.org\n/x\ny", "http://a..org/",
            "http://" + "a." * 20000 + "org/p", "http://h.net/" + "s/" * 20000, "http://h.net/?" + "k&" * 20000]
    rows = [(i, u, "x", 1) for i, u in enumerate(urls)] + [(3, "http://org/a", "x", 1)] * 5 + [(None, "http://q.com/de/1", None, None)] * 3
    _check(spark, spark.createDataFrame(rows, "page_id bigint, url string, rule string, token int").repartition(3))


def test_empty(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string")
    assert urlrules.filter_urls(empty).collect() == []
    one = spark.createDataFrame([(1, "http://a.net/x")], "page_id bigint, url string")
    assert [(r["rule"], r["mined"], r["verdict"]) for r in urlrules.filter_urls(one).collect()] == [(None, None, "allow")]


def test_mined_rules_are_all_sure_combinations(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(400):
        host, part, key = rng.choice(["a.net", "b.net", "c.net"]), rng.choice(["news", "ads", "img"]), rng.choice(["id", "ref", ""])
        bad = (part == "ads" and host != "c.net") or (part == "img" and key == "ref") or rng.random() < 0.02
        rows.append((f"http://{host}/{part}/{rng.randrange(99)}" + (f"?{key}=1" if key else ""), "block" if bad else "allow"))
    labelled = spark.createDataFrame(rows, "url string, verdict string")
    tokens = {r["url"]: frozenset(r["t"]) for r in labelled.select("url", urlrules.url_tokens(F.col("url")).alias("t")).collect()}
    found = {(frozenset(m["needs"]), m["verdict"]): (m["sure"], m["support"]) for m in urlrules.mine(labelled, 0.02, 0.85).collect()}
    named = set().union(*tokens.values())
    combos = {}
    for k in range(1, len(max(tokens.values(), key=len)) + 1):
        for combo in map(frozenset, itertools.combinations(sorted(named), k)):
            on = [v for u, v in rows if combo <= tokens[u]]
            for verdict in ("allow", "block"):
                hits = on.count(verdict)
                if hits >= 0.02 * len(rows) and hits / len(on) >= 0.85:
                    combos[combo, verdict] = (hits / len(on), hits / len(rows))
    wanted = {k: v for k, v in combos.items()
              if not any(k[1] == o[1] and o[0] < k[0] and w[0] >= v[0] for o, w in combos.items())}
    assert set(found) == set(wanted)
    assert all(abs(found[k][0] - v[0]) < 1e-9 for k, v in wanted.items())


def test_labels_decide_and_one_sided_labels(spark):
    rows = [(f"http://h{i % 5}.net/spam/{i}", "block") for i in range(40)] + [(f"http://h{i % 5}.net/good/{i}", "allow") for i in range(60)]
    labelled = spark.createDataFrame(rows + [("http://h.net/x", "other"), (None, None)], "url string, verdict string")
    pages = spark.createDataFrame([(1, "http://new.net/spam/7"), (2, "http://new.net/good/7"), (3, "http://x.org/spam/1"), (4, None)], "page_id bigint, url string")
    found, _ = _check(spark, pages, labelled)
    assert {r["page_id"]: r["verdict"] for r in found} == {1: "block", 2: "allow", 3: "allow", 4: "allow"}
    _check(spark, pages, labelled.where("verdict = 'allow'"))


def test_no_python_in_the_plan(spark):
    plan = urlrules.filter_urls(spark.read.parquet(f"{TESTDATA}/pages.parquet"))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "ExistingRDD"))
    assert "html" not in plan.split("== Physical Plan ==")[1]
    assert plan.split("== Physical Plan ==")[1].count(" Exchange") <= 1


def test_no_token_and_no_combination_is_left_out(spark):
    """Rules on a token beyond the 48 most telling ones, and beyond the ten foremost of a URL, by both ways of mining."""
    rng = random.Random(9)
    many = [(f"http://h{i % 60}.net/p{i % 60}", "block" if i % 60 < 30 else "allow") for i in range(240)]
    wide = []
    for _ in range(160):
        keys = [k for k in "abcdefghi" if rng.random() < 0.7]
        bad = "a" in keys and "i" in keys or rng.random() < 0.05
        wide.append(("http://w.net/q?" + "&".join(f"{k}=1" for k in keys), "block" if bad else "allow"))
    labelled = spark.createDataFrame(many + wide, "url string, verdict string")
    grown, levels = ({(tuple(r["needs"]), r["verdict"], round(r["sure"], 12), round(r["support"], 12), r["token"]) for r in
                      urlrules.mine(labelled, 0.01, 0.85, width).collect()} for width in (16, 0))
    assert grown == levels
    assert all(
        any(needs == (f"host h{i}.net",) for needs, *_ in grown) for i in range(60))
    assert any(needs == ("query a", "query i") and verdict == "block" for needs, verdict, *_ in grown)


def test_wide_urls_are_mined_whole(spark):
    """Forty nested sets of keys have 2^40 combinations."""
    rows = [("http://n.net/x?" + "&".join(f"k{j:02d}=1" for j in range(i % 40 + 1)), "block" if i % 40 >= 30 else "allow") for i in range(400)]
    found = {(tuple(r["needs"]), r["verdict"]) for r in urlrules.mine(spark.createDataFrame(rows, "url string, verdict string"), 0.02, 0.95).collect()}
    assert (("query k30",), "block") in found and (("query k39",), "block") in found
    assert all(len(needs) == 1 for needs, _ in found)
