from pyspark.sql import functions as F

from caseweave.llm import urlfilter as U

URLS = [
    "http://a.example.com/en/825?page=2#x", "https://example.com/en/71", "HTTP://EXAMPLE.COM/en/7", "http://com/en/", "http://notcom/en/", "http://x.net/de/9",
    "http://example.net/de/8a", "http://wwwexample.net/de/8a", "https://y.org/es/", "https://spam-farm.example.org/en/1", "https://spam-farms.org/x", "ftp://h.org?q=://z/es/",
    "no scheme casino", "free.click/win", "http://a.io/dating", "http://a.io/dating?x=dating", "http://a.io/dating/free", "http://a.io/weight-loss/pills", "http://a.io/freed/wins", "http://a.io/free-free-free", "http://a.io/free/win-bonus", "http://é.org/xxxé", "://", "http://h/#/es/", "", None, None,
]


def expected(url):
    u = url or ""
    host = path = ""
    if "://" in u:
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("#")[0].split("?")[0]
    fits = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.text), default=None)
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in u)

    def found(term):
        edge = lambda i: i < 0 or i >= len(low) or not (low[i].isascii() and low[i].isalnum())
        return any(low.startswith(term, i) and edge(i - 1) and edge(i + len(term)) for i in range(len(low)))

    strict, soft = sum(map(found, U.STRICT)), [w for t, w in U.SOFT.items() if found(t)]
    return host, path, rule and rule.text, rule.verdict if rule else "block" if strict or len(soft) >= 2 and sum(soft) >= U.SOFT_LIMIT else "allow", strict, len(soft), sum(soft)


def test_against_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("verdict", F.lit(1))
    got = {r[0]: tuple(r)[1:] for r in U.judge_urls(df).collect()}
    assert got == {i: expected(u) for i, u in enumerate(URLS)}


def test_empty(spark):
    assert U.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_sql_agrees(spark, tmp_path):
    import duckdb

    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    df.write.parquet(f"{tmp_path}/pages")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages/*.parquet'")
    assert sorted(map(tuple, U.judge_urls(df).collect()), key=str) == sorted(con.execute(U.oracle_sql()).fetchall(), key=str)


def test_vocabulary_of_a_table(spark, monkeypatch):
    rows = [("Alpha", True, None), ("beta", False, 2), ("beta", False, 1), ("gamma", None, 1), ("gamma-ray", False, 5), ("delta", False, 0), (None, True, 1), ("", True, 1), ("alpha", False, 4)]
    table = spark.createDataFrame(rows, "term string, strict boolean, weight long")
    strict, soft = U.vocabulary_of(table)
    assert strict == {"alpha"} and soft == {"beta": 2, "gamma": 1, "gamma-ray": 5}
    urls = ["h://x/alpha", "h://x/gamma-ray", "h://x/beta", "h://x/beta/gamma", "h://x/alphabet"]
    got = U.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), strict=strict, soft=soft).orderBy("page_id").collect()
    # gamma-ray holds gamma between boundaries too, so both are found
    assert [(r.verdict, r.strict_hits, r.soft_hits, r.soft_weight) for r in got] == [("block", 1, 0, 0), ("block", 0, 2, 6), ("allow", 0, 1, 2), ("block", 0, 2, 3), ("allow", 0, 0, 0)]
    none = U.judge_urls(spark.createDataFrame([(1, "h://x/alpha")], "page_id long, url string"), strict=(), soft={}).collect()
    assert none[0].verdict == "allow"
    monkeypatch.setattr(U, "VOCABULARY_MOST", 2)
    try:
        U.vocabulary_of(table)
    except U.ValidationError:
        return
    raise AssertionError("a vocabulary above its bound was taken")
