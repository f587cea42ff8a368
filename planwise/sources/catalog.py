"""Configured sources: only registered IDs can be read or browsed.

The operator registers sources (Parquet folders, SQLite files, JDBC URLs)
under IDs; users refer to IDs only, never to paths or URLs, and an unknown
ID is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwise.dataset import Dataset
from planwise.sources.parquet import read_parquet
from planwise.sources.sql import SAFE_IDENTIFIER


class UnknownSource(ValueError):
    pass


@dataclass
class SourceCatalog:
    spark: SparkSession
    _sources: dict = field(default_factory=dict)

    def add_parquet(self, source_id: str, tables: dict[str, str]) -> None:
        self._sources[source_id] = ("parquet", dict(tables))

    def add_sqlite(self, source_id: str, path: str) -> None:
        self._sources[source_id] = ("sqlite", path)

    def add_jdbc(self, source_id: str, url: str, properties: dict | None = None) -> None:
        self._sources[source_id] = ("jdbc", (url, dict(properties or {})))

    def ids(self) -> list[str]:
        return sorted(self._sources)

    def _get(self, source_id: str):
        if source_id not in self._sources:
            raise UnknownSource("Unknown configured data source")
        return self._sources[source_id]

    def read(self, source_id: str, table: str) -> DataFrame:
        kind, loc = self._get(source_id)
        if not SAFE_IDENTIFIER.match(table):
            raise UnknownSource("table must be a plain identifier")
        if kind == "parquet":
            if table not in loc:
                raise UnknownSource(f"unknown table {table!r}")
            return read_parquet(self.spark, loc[table])
        if kind == "sqlite":
            from planwise.sources.sqlite import read_sqlite
            return read_sqlite(self.spark, loc, table)
        from planwise.sources.jdbc import read_query
        url, props = loc
        return read_query(self.spark, url, f"SELECT * FROM {table}", props)

    def query(self, source_id: str, sql: str) -> DataFrame:
        """One guarded SELECT on a configured source; only that source's tables can be named.

        A JDBC source runs the query itself, read-only and under a timeout.
        The tables of another source become views of a session of their own,
        so neither the caller's views nor other sources are in reach."""
        from planwise.sources.jdbc import read_query
        from planwise.sources.sql import guarded_sql
        kind, loc = self._get(source_id)
        if kind == "jdbc":
            return read_query(self.spark, loc[0], sql, loc[1])
        own = self.spark.newSession()
        for key in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
            own.conf.set(key, self.spark.conf.get(key))
        names = loc if kind == "parquet" else [r["table"] for r in self.browse(source_id).select("table").distinct().collect()]
        alone = SourceCatalog(own, self._sources)
        for name in names:
            alone.read(source_id, name).createOrReplaceTempView(name)
        return guarded_sql(own, sql)

    def browse(self, source_id: str) -> DataFrame:
        """(table, column, type) for every table of a configured source."""
        kind, loc = self._get(source_id)
        if kind == "parquet":
            rows = [(t, f.name, f.dataType.simpleString()) for t in sorted(loc)
                    for f in read_parquet(self.spark, loc[t]).schema.fields]
        elif kind == "sqlite":
            import sqlite3
            with sqlite3.connect(f"file:{loc}?mode=ro", uri=True) as con:
                tables = [r[0] for r in con.execute(
                    "SELECT name FROM sqlite_master WHERE type='table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
                rows = [(t, c, ty) for t in tables
                        for _, c, ty, *_ in con.execute("SELECT * FROM pragma_table_info(?)", (t,))]
        else:
            url, props = loc
            info = (self.spark.read.format("jdbc").option("url", url)
                    .option("query", "SELECT table_name, column_name, data_type FROM information_schema.columns"))
            for k, v in props.items():
                info = info.option(k, v)
            return info.load().toDF("table", "column", "type")
        return self.spark.createDataFrame(rows, "table string, column string, type string")


def preview(ds: Dataset, rows: int = 50) -> tuple[list, int]:
    """The first ``rows`` rows (scan order) and the total row count."""
    return ds.df.limit(rows).collect(), ds.df.count()


def preview_frame(ds: Dataset, rows: int = 50) -> DataFrame:
    """The first ``rows`` rows with the table's total row count (a scalar
    subquery of the same lazy query)."""
    return ds.df.limit(rows).withColumn("total_rows", ds.df.agg(F.count(F.lit(1))).scalar())
