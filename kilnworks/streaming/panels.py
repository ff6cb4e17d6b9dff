"""Panels kept up to date by the stream that stores builds (ST-8)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.percentiles import counted_values, exact_percentiles
from ..runtime import maybe_broadcast
from ..sources.store import DAY_BOUND
from .ingest import CHANGES, Ingest


class PercentilePanel:
    """Exact percentiles of a build's measure by day and group.

    Every batch adds its counted values to a table by day; such tables merge by adding
    the counts, so a refreshed day reads those of its own day, never its builds. A
    repeated batch writes over its own values.
    """

    def __init__(self, ingest: Ingest, name: str, group: str, measure: str, wanted: Mapping[str, float]):
        self.ingest, self.spark = ingest, ingest.spark
        self.group, self.measure, self.wanted = group, measure, wanted
        self.parts = f"{ingest.root}/partials/{name}"
        self.path = f"{ingest.root}/panels/{name}"

    def _save(self, rows: DataFrame, path: str, *by: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            *by
        ).parquet(path)

    def store_documents(self, batch_rows: DataFrame, batch: int, run: str = "") -> None:
        """A handler of :meth:`Ingest.run`: stores the batch, then refreshes its days."""
        self.ingest.store_documents(batch_rows, batch, run)
        self.refresh(batch, run)

    def refresh(self, batch: int, run: str) -> None:
        stored = self.ingest._read("changes_builds", CHANGES)
        stored = stored.where((F.col("run") == run) & (F.col("batch") == batch))
        days = maybe_broadcast(stored.select("day").distinct(), DAY_BOUND)
        builds = self.ingest.store.read("builds").join(days, "day", "left_semi")
        new = builds.join(stored.select("day", "build_key"), ["day", "build_key"], "left_semi")
        values = counted_values(new, ["day", self.group], self.measure)
        marked = values.withColumns({"run": F.lit(run), "batch": F.lit(batch)})
        self._save(marked, self.parts, "day", "run", "batch")
        self._save(self._panel(self._partials().join(days, "day", "left_semi")), self.path, "day")

    def _partials(self) -> DataFrame:
        kinds = dict(self.ingest.store.read("builds").dtypes)
        schema = f"{self.group} {kinds[self.group]}, _v {kinds[self.measure]}, _c bigint, day date, run string, batch bigint"
        if not self.ingest.store._exists(self.parts):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.parts)

    def _panel(self, partials: DataFrame) -> DataFrame:
        return exact_percentiles(partials, ["day", self.group], "_v", self.wanted, weight="_c")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def rebuilt(self) -> DataFrame:
        """The panel from all stored builds, which it has to equal."""
        builds = self.ingest.store.read("builds")
        return exact_percentiles(builds, ["day", self.group], self.measure, self.wanted)
