"""Each registered SQL function gives what its column expression gives, over odd values."""

from pyspark.sql import functions as F

from tidemark.functions import sql
from tidemark.operators import links as L

TEXTS = [
    "https://h.test/a%20b/../c?x=1#f", "HTTP://me:pw@[::1]:8080/p//q/./r/", "10.0.0.1", "fe80::1%eth0", "a\\b'c.txt", "CON.tar.gz", "", None, "W/\"tag\"", "Fri, 31 Jul 2026 07:28:00 GMT", " 17 ", "https://h.test",
    "//other.test/x", "../up/%2e%2e/é", "?q", "mailto:x", "https://h.test/data/%252e%252e/x", "<a href=\"x'y\"><a href='z'>", "https://xn--a.h.test:22/%00", "x" * 300 + ".fits", "%zz%c3%28", "\t", "'quoted' -> (x) = y",
]


def test_functions_from_sql_are_the_column_functions(spark):
    names = sql.register(spark)
    assert len(names) == len(set(names)) > 45
    rows = [(t, TEXTS[(i * 7 + 3) % len(TEXTS)], TEXTS[(i * 5 + 1) % len(TEXTS)], i * 9_000_000, [t, "b", None, "a"]) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "u string, v string, w string, k long, a array<string>").select("*", F.encode("u", "UTF-8").alias("b"), F.timestamp_seconds("k").alias("t"))
    df.createOrReplaceTempView("odd")
    for name, (parameters, column) in sql._functions().items():
        kinds = dict(p.split(" ", 1) for p in parameters.split(", "))
        given = df.withColumn("n", F.col("k").cast(kinds["n"]) if kinds.get("n") != "INT" else (F.col("k") % 9).cast("int")) if "n" in kinds else df
        given.createOrReplaceTempView("odd")
        want = [r[0] for r in given.select(column.alias("x")).collect()]
        got = [r[0] for r in spark.sql(f"SELECT {name}({', '.join(kinds)}) AS x FROM odd").collect()]
        assert got == want, name


def test_links_table_function(spark):
    sql.register(spark)
    pages = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(99, "<a href='1'><link href=\"2\"><a href=\"#\"><a href='javascript:x'>" * 3)], "i int, html string")
    pages.createOrReplaceTempView("odd_pages")
    got = sorted((r.i, r.pos, r.href) for r in spark.sql("SELECT p.i, l.pos, l.href FROM odd_pages p, LATERAL extract_links(p.html) l").collect())
    want = sorted((r.i, r.pos, r.href) for r in pages.select("i", F.posexplode(L.hrefs(F.col("html"))).alias("pos", "href")).collect())
    assert got == want and len(got) == 8
    plan = spark.sql("SELECT l.href FROM odd_pages p, LATERAL extract_links(p.html) l")._jdf.queryExecution().toString()
    assert "Python" not in plan and "UDTF" not in plan
