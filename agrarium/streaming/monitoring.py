"""A drift monitor over micro-batches: each batch adds its state to that of the batches before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrarium.operators.sketches import STATE, Reference, merged
from agrarium.operators.store import _Files


class BatchMonitor:
    """Use as ``writeStream.foreachBatch(monitor)``.

    After batch n the folder ``state/batch=n`` holds the state of batches 0 to
    n: a row for each feature and bin, whatever has come in. It is derived from
    that of an earlier batch, so a batch that is run again writes the same.
    """

    def __init__(self, reference: Reference, root: str) -> None:
        self.reference, self.root = reference, root

    def __call__(self, batch: DataFrame, number: int) -> None:
        own = self.reference.state(batch)
        if earlier := [n for n in self.numbers(batch) if n < number]:
            own = merged(self._read(batch, earlier[-1]).unionByName(own), self.reference.reps)
        own.write.mode("overwrite").parquet(f"{self.root}/state/batch={number}")

    def numbers(self, any_df: DataFrame) -> list[int]:
        names = _Files(any_df.sparkSession, self.root).names(f"{self.root}/state")
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def _read(self, any_df: DataFrame, number: int) -> DataFrame:
        return any_df.sparkSession.read.schema(STATE).parquet(f"{self.root}/state/batch={number}")

    def report(self, any_df: DataFrame, number: int | None = None) -> DataFrame:
        """The report after a batch, the last if none is given; ``any_df`` only lends its session."""
        held = self.numbers(any_df)
        if not held:
            return self.reference.report(any_df.sparkSession.createDataFrame([], STATE)).withColumn("batch", F.lit(None).cast("int"))
        number = held[-1] if number is None else number
        return self.reference.report(self._read(any_df, number)).withColumn("batch", F.lit(number))
