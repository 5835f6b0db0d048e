"""Batches of rows brought into shape: a row that fails is set aside alone, and a batch that runs again changes nothing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.graphs import shared_folder

NORMALIZED, SKIPPED, FAILED = "NORMALIZED", "SKIPPED", "FAILED"
MOST_ERROR = 500


def isolated(rows: DataFrame, step: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType) -> DataFrame:
    """``step`` over Arrow batches of ``rows``, as ``schema`` with outcome and error; every row comes out once.

    ``step`` keeps the rows' index and may leave rows out (SKIPPED).  If it
    raises on a batch, the batch is taken by halves, so a bad row costs a few
    calls more and fails alone (FAILED, with the error's name and text).
    """
    names = schema.names
    out = StructType([*schema.fields, StructField("outcome", StringType()), StructField("error", StringType())])
    keys = [n for n in names if n in rows.columns]

    def shaped(part: pd.DataFrame, outcome: str, error: str | None = None) -> pd.DataFrame:
        part = part.reindex(columns=names).astype(object)
        return part.where(part.notna(), None).assign(outcome=outcome, error=error)

    def attempt(batch: pd.DataFrame, done: list, failed: dict) -> None:
        try:
            made = step(batch)
        except Exception as error:  # noqa: BLE001  whatever a row does must not end the others
            if len(batch) > 1:
                half = len(batch) // 2
                attempt(batch.iloc[:half], done, failed)
                attempt(batch.iloc[half:], done, failed)
            else:
                failed[batch.index[0]] = f"{type(error).__name__}: {error}"[:MOST_ERROR]
            return
        done.append(made)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # parts are put together before they are shaped, which costs more than most steps; halves never share an index
            batch = batch.reset_index(drop=True)
            done: list[pd.DataFrame] = []
            failed: dict[int, str] = {}
            attempt(batch, done, failed)
            made = pd.concat([part.astype(object) for part in done]) if done else batch.iloc[:0][keys]
            yield shaped(made, NORMALIZED)
            yield shaped(batch.loc[batch.index.difference(made.index).difference(list(failed)), keys], SKIPPED)
            if failed:
                yield shaped(batch.loc[list(failed), keys], FAILED).assign(error=list(failed.values()))

    return rows.mapInPandas(run, out)


class Ledger:
    """What was made of each key, by batch, in a folder that executors share.

    A batch's rows are written under its number, and its commit after them:
    readers see committed batches only.  A batch that was committed is not taken
    again, one that broke off is written anew.
    """

    def __init__(self, spark: SparkSession, key: str, step: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType, folder: str | None = None) -> None:
        """``schema``, of what ``step`` gives, begins with ``key``."""
        self.spark, self.key, self.step, self.schema = spark, key, step, schema
        self.folder = folder or f"{shared_folder(spark).rstrip('/')}/driftwood/ledger-{uuid.uuid4().hex}"

    def _committed(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(path)) if fs.exists(path) else []

    def entries(self) -> DataFrame:
        """All rows of committed batches: schema, outcome, error, digest, batch."""
        full = StructType([*self.schema.fields, StructField("outcome", StringType()), StructField("error", StringType()), StructField("digest", StringType()), StructField("batch", LongType())])
        paths = [f"{self.folder}/rows/batch={n}" for n in self._committed()]
        return self.spark.read.schema(full).option("basePath", f"{self.folder}/rows").parquet(*paths) if paths else self.spark.createDataFrame([], full)

    def current(self) -> DataFrame:
        """The newest entry of each key."""
        entries = self.entries()
        newest = entries.groupBy(self.key).agg(F.max("batch").alias("batch"))
        return entries.join(newest, [self.key, "batch"])

    def stale(self, inputs: DataFrame) -> DataFrame:
        """``inputs`` (key, digest and more) whose digest is not that of the key's newest entry, failed ones included: a failure is done until its input changes."""
        stamps = self.current().select(self.key, F.col("digest").alias("_digest"))
        return inputs.join(stamps, self.key, "left").filter("_digest is null or _digest <> digest").drop("_digest")

    def take(self, rows: DataFrame, batch: int) -> bool:
        """Writes a batch (rows of key, digest and what ``step`` reads); False if it was committed before."""
        if batch in self._committed():
            return False
        # of a key's rows the one of the greatest digest is taken
        last = F.row_number().over(Window.partitionBy(self.key).orderBy(F.desc("digest")))
        rows = rows.withColumn("_nth", last).filter("_nth = 1").drop("_nth")
        stamped = rows.select(self.key, "digest")
        done = isolated(rows, self.step, self.schema).join(stamped, self.key)
        done.select(*self.schema.names, "outcome", "error", "digest").write.mode("overwrite").parquet(f"{self.folder}/rows/batch={batch}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits/{batch}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True).close()
        return True

    def drain(self, inputs: DataFrame, limit: int) -> int:
        """Takes stale inputs in batches of ``limit`` by key until none is left; returns the batches taken.

        The limit bounds a batch's work, not what is seen: each batch looks at all inputs.
        """
        taken = 0
        while True:
            some = self.stale(inputs).orderBy(self.key).limit(limit)
            if some.isEmpty():
                return taken
            self.take(some, max(self._committed(), default=-1) + 1)
            taken += 1

    def follow(self, stream: DataFrame) -> Ledger:
        """Takes all that a stream has now; a batch keeps its number when it runs again."""
        query = stream.writeStream.foreachBatch(lambda rows, n: self.take(self.stale(rows), n) and None).option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return self
