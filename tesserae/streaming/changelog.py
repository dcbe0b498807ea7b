"""A log of changes before they are part of a snapshot: appended in batches, replayed after a crash, folded in from time to time."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.plans.errors import CorruptIndex
from tesserae.streaming.store import Store, latest

SCHEMA = "uri string, title string, text string, seq long, op string"


class ChangeLog:
    """`batch=<n>` folders under a path, each written by one append().

    A batch counts once Spark has marked it complete. A last batch without that mark is what a crash left: it is dropped. One
    before a complete batch can't come about by a crash, and is an error. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, most_bytes: int = 64 << 20):
        self.spark, self.path, self.most_bytes = spark, path.rstrip("/"), most_bytes

    def _fs(self, name: str = ""):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """Numbers of the complete batches, in order."""
        at, fs = self._fs()
        if not fs.exists(at):
            return []
        found = sorted(int(m[1]) for s in fs.listStatus(at) if (m := re.fullmatch(r"batch=(\d+)", s.getPath().getName())))
        done = [n for n in found if fs.exists(self._fs(f"batch={n}/_SUCCESS")[0])]
        torn = [n for n in found if n not in done]
        if torn and done and torn[0] < done[-1]:
            raise CorruptIndex(f"batch {torn[0]} of {self.path} is incomplete, but later ones are there")
        return done

    def append(self, changes: DataFrame) -> int:
        """Changes (uri, title, text, seq, op 'add' or 'remove') as one batch; its number. What a crash left under that number is replaced."""
        n = (self.batches() or [-1])[-1] + 1
        changes.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.mode("overwrite").parquet(f"{self.path}/batch={n}")
        return n

    def replay(self) -> DataFrame:
        """The last change of each uri, removals among them."""
        done = self.batches()
        if not done:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/batch={n}" for n in done])
        return latest(rows, "uri", "seq")

    def bytes(self) -> int:
        at, fs = self._fs()
        return fs.getContentSummary(at).getLength() if fs.exists(at) else 0

    def truncate(self, upto: int | None = None) -> None:
        """Delete the batches up to a number, all by default, and what crashes left."""
        at, fs = self._fs()
        if upto is None:
            fs.delete(at, True)
            return
        for n in self.batches():
            if n <= upto:
                fs.delete(self._fs(f"batch={n}")[0], True)

    def checkpoint(self, store: Store, force: bool = False) -> int | None:
        """Fold the log into the store if it has grown to most_bytes, or by force; the new epoch. The log goes only after the
        store's pointer has moved: a crash between the two folds the same changes in again, which changes nothing."""
        done = self.batches()
        if not done or not force and self.bytes() < self.most_bytes:
            return None
        epoch = store.apply(self.replay())
        self.truncate(done[-1])
        return epoch

    def view(self, store: Store) -> DataFrame:
        """Live documents (uri, title, text, seq): the store with the log over it."""
        both = store.read().withColumn("op", F.lit("add")).unionByName(self.replay())
        return latest(both, "uri", "seq").filter("op = 'add'").select("uri", "title", "text", "seq")
