"""Pairs of members: made of flat columns, with the names of a group looked up by number however many they are."""

from pyspark.sql import functions as F

from driftwood.operators import pairs

MEMBER = "event_id long, day int, words array<string>, start_min int, venue_id string, source_id long, end_date date, festival boolean"


def test_pairs_make_no_structs_and_any_number_of_names_is_met(spark):
    # 100 names of one day, of which each is met by itself and by its longer form
    rows = [(k, 1, [f"n{k % 100:02d}"] if k < 100 else [f"n{k % 100:02d}", "more"], k % 5 or None, f"v{k % 3}" if k % 4 else None, k % 7, None, None if k % 6 == 0 else k % 2 == 0) for k in range(200)]
    rows += [(900, 1, None, None, None, None, None, None), (901, None, ["n01"], 1, "v1", 1, None, True)]
    met = pairs.met(spark.createDataFrame(rows, MEMBER), ["day"])
    found = pairs.readiness(met.select(F.col("a.event_id").alias("a_id"), F.col("b.event_id").alias("b_id"), "a", "b", "names")).select("a_id", "b_id", "ready", "why", "strength", "facts")
    assert "struct(" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r["a_id"], r["b_id"]): tuple(r)[2:] for r in found.collect()}
    members = [r for r in rows if r[1] is not None]
    assert len(got) == len(members) * (len(members) - 1) // 2
    for i, a in enumerate(members):
        for b in members[i + 1 :]:
            one, two = "".join(a[2] or []), "".join(b[2] or [])
            names = bool(one and two) and (set(a[2]) <= set(b[2]) or set(b[2]) <= set(a[2]) or one in two or two in one)
            clock, place, conflict = a[3] is not None and a[3] == b[3], a[4] is not None and a[4] == b[4], None not in (a[4], b[4]) and a[4] != b[4]
            independent = None not in (a[5], b[5]) and a[5] != b[5]
            why = "RULES" if place and clock else None if conflict else "NAME_AND_START" if names and clock else "FESTIVAL_OF_TWO_SOURCES" if a[7] and b[7] and names and independent else "NAME_AND_PLACE_OF_TWO_SOURCES" if names and place and independent else None
            strength = ("STRONG" if independent or (names and clock and place) else "MODERATE") if why else "WEAK" if names or clock or place else "NONE"
            facts = ",".join(f for f, on in zip(("NAME", "START", "PLACE", "INDEPENDENT"), (names, clock, place, independent)) if on)
            assert got[a[0], b[0]] == (why is not None, why, strength, facts)
