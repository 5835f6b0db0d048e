"""Packing where texts are out of the ordinary."""

import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwood.llm import packing


@pytest.mark.parametrize("blank", [" ", "　"])
def test_a_run_of_a_million_blanks_is_packed(spark, blank):
    import public_tokenizers
    from tokenizers import Tokenizer

    text = "one <|endoftext|> two" + blank * 1_200_000 + "three"
    want = np.array([*Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids, 2], "<u4")
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    rows = sorted((r for r in packing.packed_documents(docs).collect() if r["doc_id"] == 1), key=lambda r: r["piece"])
    assert sum(r["length"] for r in rows) == len(want)
    assert all(zlib.crc32(want[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in rows)


def test_no_level_packs_more_items_at_once_than_a_group_holds(spark, monkeypatch, tmp_path):
    pack_ = packing._pack

    def told(capacity):
        run = pack_(capacity)

        def count(key, table):
            (tmp_path / f"{key[0]}-{time.time_ns()}").write_text(str(table.num_rows))
            return run(key, table)

        return count

    monkeypatch.setattr(packing, "_pack", told)
    # two to a bin, and no bin nearly full: half of the items go on
    pieces = spark.range(6400).select(F.col("id").alias("item"), (400 + F.col("id") % 100).alias("length"))
    placed = packing.pack(pieces, group_items=100, fan_in=8)
    assert placed.select("item").distinct().count() == placed.count() == 6400
    sizes = [int(f.read_text()) for f in tmp_path.iterdir()]
    assert max(sizes) < 200


def test_rows_without_id_and_repeated_rows_are_packed_each(spark):
    rows = [(None, "a b c"), (None, "a b c"), (1, "same"), (1, "same"), (1, "unlike"), (2, None)]
    found = packing.packed_documents(spark.createDataFrame(rows, "doc_id long, text string"), group_items=2, fan_in=2).collect()
    assert len(found) == 6 and len({(r["sequence_id"], r["offset"]) for r in found}) == 6
    assert len({r["sequence_id"] for r in found}) == 1


def test_levels_cost_little_against_one_group(spark):
    pieces = spark.range(20_000).select(F.col("id").alias("item"), (1 + F.pmod(F.xxhash64("id"), F.lit(900))).alias("length"))
    total = pieces.agg(F.sum("length")).first()[0]
    one = packing.pack(pieces, group_items=1 << 30).select("sequence_id").distinct().count()
    levels = packing.pack(pieces, group_items=700, fan_in=4).select("sequence_id").distinct().count()
    # groups of 700 items cost about a hundredth here; groups of production size hold more partners
    assert one <= levels <= 1.015 * one and one <= 1.01 * total / packing.CAPACITY + 2
