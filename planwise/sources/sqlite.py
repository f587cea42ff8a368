"""Read-only SQLite tables as a partitioned Spark source.

A Python Data Source: the driver reads the table's rowid range, each task
opens the file read-only (``mode=ro`` + ``query_only``) and scans its own
rowid slice, so a large table is read in parallel.  Only an allow-listed
table name (a plain identifier) can be named; no SQL text is accepted.
"""

from __future__ import annotations

import re
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
_TYPES = {"INTEGER": "bigint", "INT": "bigint", "REAL": "double", "FLOAT": "double", "DOUBLE": "double",
          "NUMERIC": "double", "TEXT": "string", "VARCHAR": "string", "BOOLEAN": "boolean"}


def _connect(path: str) -> sqlite3.Connection:
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    con.execute("PRAGMA query_only=ON")
    return con


def _columns(path: str, table: str) -> list[tuple[str, str]]:
    if not IDENTIFIER.match(table):
        raise ValueError("table must be a plain identifier")
    with _connect(path) as con:
        cols = con.execute("SELECT name, type FROM pragma_table_info(?)", (table,)).fetchall()
    if not cols:
        raise ValueError(f"unknown table {table!r}")
    return [(n, _TYPES.get(str(t).upper().split("(")[0], "string")) for n, t in cols]


class RowidRange(InputPartition):
    def __init__(self, lo: int, hi: int):
        super().__init__((lo, hi))
        self.lo, self.hi = lo, hi


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[tuple[str, str]]):
        self.path = options["path"]
        self.table = options["table"]
        self.parts = int(options.get("partitions", "4"))
        self.columns = columns

    def partitions(self):
        with _connect(self.path) as con:
            lo, hi = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if lo is None:
            return [RowidRange(0, -1)]
        step = max((hi - lo + 1) // self.parts, 1)
        bounds = list(range(lo, hi + 1, step)) + [hi + 1]
        return [RowidRange(a, b - 1) for a, b in zip(bounds[:-1], bounds[1:])]

    def read(self, partition: RowidRange):
        names = ", ".join(f'"{n}"' for n, _ in self.columns)
        with _connect(self.path) as con:
            cur = con.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?',
                              (partition.lo, partition.hi))
            for row in cur:
                yield tuple(row)


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "planwise_sqlite"

    def _cols(self):
        return _columns(self.options["path"], self.options["table"])

    def schema(self) -> str:
        return ", ".join(f"`{n}` {t}" for n, t in self._cols())

    def reader(self, schema):
        return SqliteReader(self.options, self._cols())


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 4) -> DataFrame:
    if not IDENTIFIER.match(table):
        raise ValueError("table must be a plain identifier")
    spark.dataSource.register(SqliteSource)
    return (spark.read.format("planwise_sqlite").option("path", path).option("table", table)
            .option("partitions", str(partitions)).load())
