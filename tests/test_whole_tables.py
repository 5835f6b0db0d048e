"""Queries over whole tables: no rows are picked by their ids."""

from pyspark.sql import functions as F

from driftwood.plans import registered

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return registered()[name][0](spark, SF)


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_usage_counts_every_event(spark):
    january = table(spark, "events").filter("to_date(ts) between '2024-01-01' and '2024-01-31'")
    assert run(spark, "usage_daily").agg(F.sum("n")).first()[0] == january.count() > 0


def test_every_festival_and_programme_is_read(spark):
    nights = run(spark, "festival_nights").select("post_id").distinct().count()
    assert nights == table(spark, "orders").filter("o_orderkey % 9 > 0").count()
    assert run(spark, "programme_lines").count() == table(spark, "lineitem").count()


def test_images_fill_candidates_of_every_post(spark):
    found = {r["post_id"] % 20 for r in run(spark, "image_fallback").select("post_id").distinct().collect()}
    assert found == set(range(20))


def test_every_asked_event_is_looked_up(spark):
    asked = table(spark, "lineitem").filter("l_returnflag = 'A'").select("l_orderkey").distinct().count()
    assert run(spark, "lookup_with_redirect").count() == asked


def test_components_are_those_of_every_line(spark):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for r in table(spark, "lineitem").select("l_partkey", "l_suppkey").distinct().collect():
        a, b = sorted((find(r["l_partkey"] * 2), find(r["l_suppkey"] * 2 + 1)))
        root[b] = a
    assert {r["node"]: r["root"] for r in run(spark, "cross_post_components").collect()} == {x: find(x) for x in list(root)}
