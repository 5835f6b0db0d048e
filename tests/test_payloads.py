"""Typed values, hydrated lists, labelled rows, scans by day, and place strings."""

import json

from pyspark.sql import functions as F

from driftwood.functions import addresses
from driftwood.sources import payloads


def test_typed_values_become_plain_ones_to_any_depth(spark):
    deep = {"mapValue": {"fields": {"x": {"arrayValue": {"values": [{"integerValue": "7"}, {"mapValue": {"fields": {"y": {"booleanValue": True}, "n": {"nullValue": None}}}}, {"strangeValue": 1}, {}]}}, "e": {"arrayValue": {}}, "m": {"mapValue": {}}}}}
    for _ in range(30):
        deep = {"mapValue": {"fields": {"d": deep}}}
    fields = {"s": {"stringValue": "ä"}, "i": {"integerValue": "12"}, "odd": {"integerValue": "many"}, "f": {"doubleValue": 1.5}, "t": {"timestampValue": "2024-01-01T00:00:00Z"}, "g": {"geoPointValue": {"latitude": 1}}, "deep": deep}
    docs = {"documents": [{"name": "a/b/one", "fields": fields}, {"name": "a/b/two", "fields": [1]}, {"name": "a/b/three"}]}
    rows = spark.createDataFrame([(1, json.dumps(docs)), (2, "{broken"), (3, None), (4, "{}")], "payload_id long, payload string")
    found = {r["document_id"]: r["fields"] for r in payloads.typed_documents(rows).select("document_id", F.to_json("fields").alias("fields")).collect()}
    plain = {"x": [7, {"y": True, "n": None}, None, None], "e": [], "m": {}}
    for _ in range(30):
        plain = {"d": plain}
    assert json.loads(found["one"]) == {"s": "ä", "i": 12, "odd": "many", "f": 1.5, "t": "2024-01-01T00:00:00Z", "g": {"latitude": 1}, "deep": plain}
    assert found["two"] is None and found["three"] is None and len(found) == 3


def page(tree):
    return f'<html><script id="__DATA__" type="application/json">{tree if isinstance(tree, str) else json.dumps(tree)}</script></html>'


def test_a_list_that_is_gone_is_not_an_empty_one(spark):
    full = {"props": {"days": [{"rows": [{"id": 1, "title": "a"}, {"id": 2}]}, {"rows": None}, {"rows": [{"id": 3, "title": "c"}]}], "x": 1}}
    trees = [full, {"props": {"days": []}}, {"props": {"days": None}}, {"props": {}}, {"other": 1}, "{broken"]
    rows = [(k, page(t)) for k, t in enumerate(trees)] + [(9, "<html></html>"), (10, None)]
    found = payloads.hydrated(spark.createDataFrame(rows, "page_id long, html string"), "__DATA__", ["props", "days"], "rows", "struct<id: long, title: string>")
    got = {}
    for r in found.collect():
        got.setdefault((r["page_id"], r["status"]), []).append(r["item"] and (r["item"]["id"], r["item"]["title"]))
    assert got == {(0, "PASS"): [(1, "a"), (2, None), (3, "c")], (1, "VALID_EMPTY"): [None], (2, "VALID_EMPTY"): [None], **{(k, "PARSING_FAILED"): [None] for k in (3, 4, 5, 9, 10)}}


def test_labelled_rows_mind_nesting_and_unclosed_elements(spark):
    html = """<dl><dt>Date<dd>May <b>4</b> &amp; 5<br>evening<dt>PLACE</dt><dd>Hall<script>x</script><dl><dt>Room</dt><dd>2</dd></dl> back</dd></dl><dl><dt>Fee</dt><dd></dd><dd>10</dl><dd>stray</dd>"""
    rows = spark.createDataFrame([(1, html), (2, None), (3, "plain"), (4, "<dl><dt>A<dd>b")], "id long, html string").select("id", payloads.labelled_rows(F.col("html")).alias("rows"))
    rows = rows.select("*", payloads.row_of(F.col("rows"), "date").alias("date"), payloads.row_of(F.col("rows"), "fee").alias("fee"))
    got = {r["id"]: r for r in rows.collect()}
    assert [(x["label"], x["value"]) for x in got[1]["rows"]] == [("Date", "May 4 & 5\nevening"), ("Room", "2"), ("PLACE", "HallRoom2 back"), ("Fee", ""), ("Fee", "10"), (None, "stray")]
    assert got[1]["date"] == "May 4 & 5\nevening" and got[1]["fee"] is None
    assert got[2]["rows"] == [] and got[3]["rows"] == [] and [(x["label"], x["value"]) for x in got[4]["rows"]] == [("A", "b")]


def test_a_failed_day_leaves_the_others(spark):
    link = lambda *names: "".join(f'<a href="/{n}">x</a>' for n in names)
    rows = [("a", 1, "day=1" + link("x", "y")), ("a", 2, None), ("a", 3, "day=4" + link("z")), ("a", 4, "day=4"), ("a", 5, "day=5" + link("y", "w&amp;v")), ("b", 1, "day=1"), ("c", 1, "no header" + link("q")), ("c", 2, None)]
    asked = spark.createDataFrame(rows, "scan string, day int, html string")
    days = payloads.day_statuses(asked, F.expr("try_cast(regexp_extract(html, 'day=([0-9]+)', 1) as int)"), r'<a href="([^"]*)"')
    assert {(r["scan"], r["day"]): r["status"] for r in days.collect()} == {("a", 1): "PASS", ("a", 2): "FETCH_FAILED", ("a", 3): "PARSING_FAILED", ("a", 4): "VALID_EMPTY", ("a", 5): "PASS", ("b", 1): "VALID_EMPTY", ("c", 1): "PARSING_FAILED", ("c", 2): "FETCH_FAILED"}
    assert {r["scan"]: (r["status"], r["days"], r["failed"], r["links"]) for r in payloads.scan_statuses(days).collect()} == {"a": ("PARTIAL", 5, 2, ["/x", "/y", "/w&v"]), "b": ("PASS", 1, 0, []), "c": ("FAILED", 2, 2, [])}


def test_places_are_taken_apart_at_their_last_brackets(spark):
    cases = {
        "Bar Luna (서울 마포구 잔다리로 5, 2층)": ("Bar Luna", "서울 마포구 잔다리로 5, 2층", "서울"),
        "Bar Luna (바 루나) (창원시 용지로 4 (용호) 2층)": ("Bar Luna", "창원시 용지로 4 (용호) 2층", None),
        "Bar (Luna Studio)": ("Bar", None, None),
        "Bar (서울 중구 을지로 1) (부산 수영구 광안로 2)": ("Bar", None, None),
        "Bar (unclosed": ("Bar (unclosed", None, None),
        "Bar) (x": ("Bar) (x", None, None),
        "Bar x)": ("Bar x)", None, None),
        "(서울 중구 을지로 1)": ("(서울 중구 을지로 1)", None, None),
        "Bar (광주 북구 중앙로 3)": ("Bar", "광주 북구 중앙로 3", "광주"),
        "Bar (광주시 경안로 3)": ("Bar", "광주시 경안로 3", None),
        "": ("", None, None),
    }
    rows = spark.createDataFrame([(k, v) for k, v in enumerate([*cases, None])], "id int, raw string").select("id", "raw", addresses.place_parts(F.col("raw"), F.array(F.lit(" Luna "), F.lit("서울 중구 을지로 1"), F.lit(None).cast("string"))).alias("p"))
    got = {r["raw"]: r["p"] for r in rows.collect()}
    assert {raw: (p["name"], p["address"], p["region"]) for raw, p in got.items() if raw is not None} == cases
    assert got["Bar Luna (바 루나) (창원시 용지로 4 (용호) 2층)"]["aliases"] == ["바 루나", "Bar Luna (바 루나) (창원시 용지로 4 (용호) 2층)", "Luna"]
    assert got[None]["name"] == "" and got[None]["aliases"] == ["Luna"] and not got["Bar x)"]["inferred"] and got["Bar (Luna Studio)"]["inferred"]


def test_whole_pages_are_not_held_in_arrow_batches(spark):
    pages = spark.createDataFrame([("<dl><dt>when<dd>now</dl>",), (None,)], "html string")
    found = pages.select(payloads.labelled_rows(F.col("html")).alias("r"))
    assert sorted(str(r["r"]) for r in found.collect()) == ["[Row(label='when', value='now')]", "[]"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
