"""Bodies that arrive after their items: read once, folded in order, corrected instead of dropped.

A stream of versions of items (item_id, at, kind, status, text) is followed in
batches that may come in any order.  Each different text is read once, whatever
items show it.  An item's log has no texts; when a batch touches an item its
whole log is folded again by time, and what comes out otherwise than before is
written as a correction.  So the answers depend on the set of versions alone.
Tables of a batch are written under its number: a batch that runs again writes
the same files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graphs import shared_folder

CANDIDATE = "struct<key: string, title: string, detail: string>"
_LOG = f"item_id long, at long, digest string, kind string, status string, length long, candidates array<{CANDIDATE}>"
_FOLDED = "item_id long, at long, digest string, nth long, outcome string, kept long, added long, retired long, candidates array<struct<candidate_id: string, key: string, title: string, detail: string>>"


def _paired(old: list[dict], new: list[dict]) -> dict[int, int]:
    """new index -> old index: one to one where there is one of each, else by tiers of keys that one on either side has."""
    if len(old) == len(new) == 1:
        return {0: 0}
    pairs: dict[int, int] = {}
    for fields in (("key", "title"), ("key",), ("title",)):
        sides: list[dict[tuple, list[int]]] = []
        for rows, taken in ((old, set(pairs.values())), (new, set(pairs))):
            by_key: dict[tuple, list[int]] = {}
            for i, row in enumerate(rows):
                if i not in taken and all(row[f] is not None for f in fields):
                    by_key.setdefault(tuple(row[f] for f in fields), []).append(i)
            sides.append(by_key)
        for key, at in sides[1].items():
            if len(at) == 1 and len(sides[0].get(key, ())) == 1:
                pairs[at[0]] = sides[0][key][0]
    return pairs


class _Item:
    """One item's candidates as its versions are folded in order."""

    def __init__(self, item_id: int) -> None:
        self.item_id, self.candidates, self.digest, self.reviewed, self.best, self.made, self.nth = item_id, [], None, False, 0, 0, 0

    def fold(self, row) -> dict:
        kept = added = retired = 0
        if row.kind == "REVIEW":
            self.reviewed, outcome = True, "REVIEWED"
        elif row.digest == self.digest:
            outcome = "UNCHANGED"
        elif self.reviewed:
            outcome = "KEPT_HUMAN_REVIEWED"
        elif row.status == "BLOCKED" and row.length < self.best:
            outcome = "PRESERVED_BODY_LOST"
        else:
            outcome, self.digest = "EXTRACTED", row.digest
            new = [dict(c) for c in (row.candidates if row.candidates is not None else [])]
            pairs = _paired(self.candidates, new)
            for i, candidate in enumerate(new):
                if i in pairs:
                    candidate["candidate_id"] = self.candidates[pairs[i]]["candidate_id"]
                else:
                    candidate["candidate_id"] = f"{self.item_id}-{self.made}"
                    self.made += 1
            kept, added, retired = len(pairs), len(new) - len(pairs), len(self.candidates) - len(pairs)
            self.candidates = new
        if row.kind != "REVIEW" and row.status != "BLOCKED":
            self.best = max(self.best, row.length)
        self.nth += 1
        return {"item_id": self.item_id, "at": row.at, "digest": row.digest, "nth": self.nth, "outcome": outcome, "kept": kept, "added": added, "retired": retired, "candidates": None}


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted logs of items, one row for each version; the last one of an item has its candidates."""
    item, out, last = None, [], None
    for batch in batches:
        for row in batch.itertuples(index=False):
            if item is None or item.item_id != row.item_id:
                if last is not None:
                    last["candidates"] = item.candidates
                    out.append(last)
                item, last = _Item(row.item_id), None
            if last is not None:
                out.append(last)
            last = item.fold(row)
        if out:
            yield pd.DataFrame(out)
            out = []
    if last is not None:
        last["candidates"] = item.candidates
        yield pd.DataFrame([*out, last])


def folded_versions(log: DataFrame, readings: DataFrame) -> DataFrame:
    """Every version's outcome, and with an item's last one its candidates; ``log`` rows that repeat are one.

    An item's log is walked in its task row by row, and only its candidates are held.
    """
    once = log.dropDuplicates(["item_id", "at", "kind", "digest", "status"])
    full = once.join(readings, "digest", "left").select("item_id", "at", "digest", "kind", "status", "length", "candidates")
    return full.repartition("item_id").sortWithinPartitions("item_id", "at", "kind", "digest", "status").mapInPandas(_folded, _FOLDED)


def versions(rows: DataFrame) -> DataFrame:
    """Log rows of (item_id, at, kind, status, text) with the text's digest and length; a null text is empty."""
    text = F.coalesce("text", F.lit(""))
    return rows.select(F.col("item_id").cast("long").alias("item_id"), F.col("at").cast("long").alias("at"), "kind", "status", F.sha2(text, 256).alias("digest"), F.length(text).cast("long").alias("length"), text.alias("text"))


class LateReadings:
    """The tables of a followed stream: log, readings, outcomes, corrections, by batch, in a folder that executors share."""

    def __init__(self, spark: SparkSession, read: Callable[[DataFrame], DataFrame], folder: str | None = None) -> None:
        """``read`` turns (digest, text) into (digest, candidates)."""
        self.spark, self.read = spark, read
        self.folder = folder or f"{shared_folder(spark).rstrip('/')}/driftwood/late-{uuid.uuid4().hex}"
        self.batches = self._finished()

    def _finished(self) -> list[int]:
        """Batches whose last table is whole; a driver that starts again goes on after them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/corrections")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [f.getPath() for f in fs.listStatus(path)] if fs.exists(path) else []
        whole = [p.getName() for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(name.partition("=")[2]) for name in whole)

    def _table(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        paths = [f"{self.folder}/{name}/batch={n}" for n in self.batches if before is None or n < before]
        empty = self.spark.createDataFrame([], f"{schema}, batch int")
        if not paths:
            return empty
        return self.spark.read.schema(empty.schema).option("basePath", f"{self.folder}/{name}").parquet(*paths)

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def take(self, rows: DataFrame, batch: int) -> None:
        """One batch: new texts are read, touched items folded, differences written."""
        log_schema, reading_schema = "item_id long, at long, kind string, status string, digest string, length long", f"digest string, candidates array<{CANDIDATE}>"
        new = versions(rows)
        self._write(new.drop("text"), "log", batch)
        known = self._table("readings", reading_schema, batch)
        # rows of one text are read once
        unread = new.filter("kind <> 'REVIEW'").groupBy("digest").agg(F.any_value("text").alias("text")).join(known.select("digest"), "digest", "left_anti")
        self._write(self.read(unread).select("digest", "candidates"), "readings", batch)
        self.batches = sorted({*self.batches, batch})
        touched = self._table("log", log_schema).filter(F.col("batch") == batch).select("item_id").distinct()
        log = self._table("log", log_schema).filter(F.col("batch") <= batch).join(touched, "item_id", "left_semi")
        readings = self._table("readings", reading_schema).filter(F.col("batch") <= batch).select("digest", "candidates")
        self._write(folded_versions(log.drop("batch"), readings), "outcomes", batch)
        # what this item's versions were said to be before
        before = self._latest(self._table("outcomes", _FOLDED, batch)).join(touched, "item_id", "left_semi")
        now = self._table("outcomes", _FOLDED).filter(F.col("batch") == batch)
        keys = ["item_id", "at", "digest"]
        was = before.select(*keys, F.col("outcome").alias("was"))
        changed = now.join(was, keys).filter("outcome <> was").select(*keys, "was", "outcome")
        self._write(changed, "corrections", batch)

    @staticmethod
    def _latest(outcomes: DataFrame) -> DataFrame:
        newest = outcomes.groupBy("item_id").agg(F.max("batch").alias("batch"))
        return outcomes.join(newest, ["item_id", "batch"])

    def outcomes(self) -> DataFrame:
        """item_id, at, digest, nth, outcome, kept, added, retired of every version, as known now."""
        return self._latest(self._table("outcomes", _FOLDED)).drop("batch", "candidates")

    def candidates(self) -> DataFrame:
        """item_id, candidate_id, key, title, detail, as known now."""
        return self._latest(self._table("outcomes", _FOLDED)).select("item_id", F.explode("candidates").alias("c")).select("item_id", "c.*")

    def corrections(self) -> DataFrame:
        """item_id, at, digest, was, outcome, batch: versions whose outcome a later arrival changed."""
        return self._table("corrections", "item_id long, at long, digest string, was string, outcome string")

    def follow(self, stream: DataFrame) -> LateReadings:
        """Takes all that the stream has now."""
        query = stream.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return self
