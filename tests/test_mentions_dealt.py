"""Texts that hold a place's name stand together when they meet its places."""

from pyspark.sql import functions as F

from driftwood.operators import summaries


def test_a_task_meets_few_names_and_no_mention_is_lost(spark):
    texts = spark.createDataFrame([(k, f"at night club{chr(97 + k % 6)} and so on", k % 4, k % 3) for k in range(300)], "text_id long, text string, region int, genre int")
    places = spark.createDataFrame([(p, f"Club {chr(97 + p % 6)}", p % 4, p % 3) for p in range(60)], "place long, name string, p_region int, p_genre int")
    rows = summaries.mentions(texts, places).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["text_id"], r["place"], r["agreed"]) for r in rows) == sorted((k, p, k % 4 == p % 4 or k % 3 == p % 3) for k in range(300) for p in range(60) if k % 6 == p % 6)
    names = {}
    for r in rows:
        names.setdefault(r["task"], set()).add(r["place"] % 6)
    assert len(names) > 1 and max(map(len, names.values())) <= 4
