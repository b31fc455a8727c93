import duckdb
import pytest

from tessera.llm import url_filter as uf

URLS = [
    (1, "https://EXAMPLE.org/en/12?x#y"), (2, "http://a.example.org/es/1"), (3, "http://example.org"), (4, "http://notexample.org/es/1"), (5, None), (6, "no scheme/x"),
    (7, "x://Shop.Com/fr/1"), (8, "x://shop.com/de/"), (9, "x://shop.com/d"), (10, "x://10.0.0.1/a/5"), (11, "x://a.b.co.uk/7.html"), (12, "://"), (13, "a://b://c/d"), (14, "http://com/fr/2"),
    (15, "http://user@h.net:80/p?q/r"), (None, "http://h.net/9"), (1, "https://EXAMPLE.org/en/12?x#y"), (16, "http://É.Net/Ä"), (17, "http://h.net/" + "p" * 100_000),
]


def test_oracle_and_rules(spark, tmp_path):
    pages = spark.createDataFrame(URLS + [(100 + i, f"http://bad.example.net/en/{i}") for i in range(60)] + [(200 + i, f"http://ok.example.net/en/{1000 + i}") for i in range(60)], "page_id long, url string").withColumn("html", uf.F.lit("x"))
    labels = spark.createDataFrame([(i, 0, 0) for i in range(60)] + [(1000 + i, 1, 0) for i in range(60)] + [(5, 1, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = [tuple(r) for r in uf.op4_url_filter(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(uf.OP4_SQL).fetchall()
    assert sorted(got, key=str) == sorted(want, key=str)
    by = {r[0]: r[1:] for r in got}
    assert by[1] == ("example.org", "/en/12", "example.org/en/1", "block") and by[2][2:] == ("example.org/es/", "block")
    assert by[3][:3] == ("example.org", "", None) and by[4][2:] == ("org/", "allow") and by[5][:2] == by[6][:2] == ("", "")
    assert by[7] == ("shop.com", "/fr/1", "com/fr/", "allow") and by[8][2:] == ("com/de/", "block") and by[9][2] is None
    assert by[13][:3] == ("b:", "//c/d", None) and by[14][2] == "com/fr/" and by[15][:2] == ("user@h.net:80", "/p") and by[16][0] == "É.net"
    assert by[101][3] == "block" and by[201][3] == "allow"


def test_shrinkage(spark):
    rows = [("a.x.com", 1)] * 3 + [("b.x.com", 1)] * 40 + [("c.x.com", 1)] * 20 + [("d.y.com", 0)] * 80 + [("e.y.com", 1)] + [("f.y.com", None)]
    got = {r.host: r for r in uf.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["a.x.com"].rate > got["e.y.com"].rate > got["d.y.com"].rate  # one bad page says less in a good domain
    assert got["b.x.com"].low > got["a.x.com"].low and got["f.y.com"].n == 0 and 0 < got["f.y.com"].rate < 0.5
    assert uf.host_reputation(spark.createDataFrame([], "host string, bad int")).collect() == []


def test_suffixes_are_a_parameter(spark):
    lines = spark.createDataFrame([("// list",), ("cn",), ("COM.cn",), ("k12.ma.us",), ("*.ck",), ("!www.ck",), (" gov.uk ",), (None,)], "suffix string")
    own = uf.read_suffixes(lines)
    assert own == ["com.cn", "gov.uk", "k12.ma.us"]
    hosts = spark.createDataFrame([("a.b.com.cn",), ("x.y.k12.ma.us",), ("y.ma.us",), ("com.cn",), ("10.0.0.1",)], "host string")
    got = {r.host: (r.s, r.d) for r in hosts.select("host", uf.suffix_domain(uf.F.col("host"), own)[0].alias("s"), uf.suffix_domain(uf.F.col("host"), own)[1].alias("d")).collect()}
    assert got == {"a.b.com.cn": ("com.cn", "b.com.cn"), "x.y.k12.ma.us": ("k12.ma.us", "y.k12.ma.us"), "y.ma.us": ("us", "ma.us"), "com.cn": ("com.cn", "com.cn"), "10.0.0.1": ("ip", "10.0.0.1")}
    rows = [("a.bad.com.cn", 1)] * 40 + [("b.bad.com.cn", 0)] * 2 + [("good.com.cn", 0)] * 60 + [("few.com.cn", None)]
    rate = lambda *s: {r.host: r.rate for r in uf.host_reputation(spark.createDataFrame(rows, "host string, bad int"), *s).collect()}
    one, apart = rate(), rate(own)
    assert apart["b.bad.com.cn"] - apart["few.com.cn"] > one["b.bad.com.cn"] - one["few.com.cn"]


@pytest.mark.parametrize("bad", [0, 1])
def test_one_sided_outcomes(spark, bad):
    got = uf.host_reputation(spark.createDataFrame([("h.com", bad)] * 5, "host string, bad int")).head()
    assert 0 < got.rate < 1
