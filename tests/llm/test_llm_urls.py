import random
import time

from oracle import same
from pyspark.sql import functions as F

from quarrydf.llm import urls
from quarrydf.llm.urls import Rule


def test_query_matches_sql(spark, sf):
    same(urls.op10_url_filters(spark, sf), urls.OP10_SQL, sf)


def test_odd_urls_match_sql(spark, tmp_path):
    odd = [None, "", "no scheme", "http://", "https://COM/", "http://com", "http://xcom/", "http://a.com?x/en/", "http://WWW.Example.Com/en/x", "http://a.example.com/en", "http://a.example.com/en/", "http://example.com/EN/", "x://y.net/es/#/fr/", "x://net/fr/?", "http://É.net/fr/", "http://u@a.com:80/", "http://a.com://b/", "http://a.b..com/", "//a.com/"]
    spark.createDataFrame([(i, u, "x") for i, u in enumerate(odd + odd[:3])], "page_id long, url string, verdict string").write.parquet(f"{tmp_path}/p.parquet")
    (tmp_path / "pages.parquet").mkdir()
    df = spark.read.parquet(f"{tmp_path}/p.parquet").coalesce(1)
    df.write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
    got = urls.op10_url_filters(spark, str(tmp_path))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute("SELECT page_id, host, path, rule, verdict FROM (" + urls.OP10_SQL + ")").fetchall()
    # SQL sees a null url as null; the contract says empty
    want = [(p, h or "", q or "", r, v) for p, h, q, r, v in want]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def brute(rules, host, path):
    fits = [(len(r.name), len(r.host), -i, r) for i, r in enumerate(rules) if (host == r.host or host.endswith("." + r.host) or not r.host) and path.startswith(r.path)]
    return max(fits)[3] if fits else None


def test_trie_against_brute_force():
    rng = random.Random(0)
    label, part = lambda: rng.choice("abc"), lambda: rng.choice(["a", "ab", "b", ""])
    host = lambda n: ".".join(label() for _ in range(rng.randint(1, n)))
    path = lambda n: "".join("/" + part() for _ in range(rng.randint(0, n)))
    for _ in range(40):
        rules = [Rule(rng.choice(["allow", "block"]), host(3), path(3)) for _ in range(12)] + [Rule("block", "", "/b")]
        trie = urls.UrlTrie(rules)
        for _ in range(150):
            h, p = host(4), path(4)
            assert trie.match(h, p) == brute(rules, h, p)


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(df, urls.RULES).count() == 0


def test_long_urls_take_linear_time():
    trie = urls.UrlTrie(urls.RULES + [Rule("block", "com", "/aaa")])

    def seconds(n):
        began = time.perf_counter()
        assert trie.match("a.com", "/" + "a" * n).path == "/aaa" and trie.match("a.com", "/x" * n).path == "/"
        return time.perf_counter() - began

    short, long = (min(seconds(n) for _ in range(5)) for n in (200_000, 400_000))
    assert long < 3 * short + 0.05


def test_more_rules_than_one_trie_holds(spark, monkeypatch):
    rng = random.Random(3)
    rules = [Rule(rng.choice(["allow", "block"]), ".".join(rng.choice("ab") for _ in range(rng.randint(1, 3))), rng.choice(["/", "/a", "/a/b"])) for _ in range(11)]
    rows = [(i, f"x://{'.'.join(rng.choice('abc') for _ in range(rng.randint(1, 4)))}{rng.choice(['', '/', '/ab/', '/a/bc'])}") for i in range(200)] + [(200, None)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("judged", F.lit("mine")).withColumn("hit", F.lit("mine"))
    whole = sorted(map(tuple, urls.judge(df, rules).collect()))
    monkeypatch.setattr(urls, "MAX_RULES", 4)
    assert sorted(map(tuple, urls.judge(df, rules).collect())) == whole
    monkeypatch.undo()
    for i, u in rows[:-1]:
        rule = brute(rules, *urls.host_and_path(u))
        assert whole[i][6] == (rule.name if rule else None)
    assert urls.judge(df, []).filter("verdict <> 'allow'").count() == 0
