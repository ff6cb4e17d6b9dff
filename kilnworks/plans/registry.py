"""Registration of queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import written, written_by
from .views import table, with_views


class Tables:
    """Stand-in tables by name: ``t.builds`` is the view ``v_builds``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.kept: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, f"v_{name}", self.kept)

    def keep(self, name: str, key: str = "", columns: tuple[str, ...] = ("*",)) -> None:
        """Store a view, in buckets of ``key`` if given; views that read it then don't
        derive it each time. ``columns`` are those that they read."""
        rows, label = getattr(self, name).select(*columns), name.replace("_", "-")
        self.kept[f"v_{name}"] = written_by(rows, label, key) if key else written(rows, label)[0]

    def deal(self, base: str, key: str) -> None:
        """Deal a base table out like buckets of the text of its ``key``: rows that views
        derive from it under that key then lie where such a view's buckets are."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.kept[base] = self.base(base).repartition(n, F.col(key).cast("string"))

    def place(self, columns: tuple[str, ...]) -> None:
        """Line items move once, with the ``columns`` that are read, to the place of their
        build, and orders to theirs; what views derive of them by build lies there too."""
        if "v_items" not in self.kept:
            self.keep("items", "build_key", columns)
            self.deal("orders", "o_orderkey")

    def by_build(self, rows: DataFrame) -> DataFrame:
        """Rows that lie elsewhere, moved once to where :meth:`place` puts their build."""
        return rows.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "build_key")

    def base(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    queries: dict[str, Query] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)

    def add(
        self, name: str, run: Callable[[Tables], DataFrame], views: str = "", sql: str = ""
    ) -> None:
        if name in self.queries:
            raise ValueError(f"query {name} registered twice")
        self.queries[name] = lambda spark, sf_dir: run(Tables(spark, sf_dir))
        if sql:
            self.oracles[name] = with_views(views, sql)


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """Rounds sums and means, so that the order of addition does not show."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


def day_text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns or ("day",)})
