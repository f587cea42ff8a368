"""Typed tables with stable field IDs (the library's data model).

Every column of a ``Dataset`` has a stable ID (the DataFrame column name), a
display name that may repeat, and one of four logical dtypes.  Imported files
get positional IDs ``f1..fn``; existing tables may keep their column names as
IDs.  Metadata travels in ``StructField.metadata`` so it survives Parquet.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

DTYPES = ("string", "number", "date", "boolean")


class DatasetError(ValueError):
    """Raised for schema problems: unknown IDs, ambiguous names, bad dtypes."""


def logical_dtype(data_type: T.DataType) -> str:
    """Map a Spark type to one of the four logical dtypes."""
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "date"
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    raise DatasetError(f"unsupported column type {data_type.simpleString()}; "
                       "only string, number, date and boolean columns can be analysed")


@dataclass(frozen=True)
class Field:
    id: str
    name: str
    dtype: str
    meaning: str = ""

    def __post_init__(self) -> None:
        if self.dtype not in DTYPES:
            raise DatasetError(f"dtype must be one of {DTYPES}, got {self.dtype!r}")


@dataclass(frozen=True)
class Dataset:
    """A DataFrame plus field metadata and lineage."""

    df: DataFrame
    fields: tuple[Field, ...]
    source: str = ""
    warnings: tuple[str, ...] = ()
    transforms: tuple[dict, ...] = field(default_factory=tuple)

    # ---- construction -------------------------------------------------
    @classmethod
    def from_frame(
        cls,
        df: DataFrame,
        names: list[str] | None = None,
        positional_ids: bool = False,
        source: str = "",
        meanings: dict[str, str] | None = None,
    ) -> "Dataset":
        """Wrap a DataFrame.

        ``positional_ids=True`` renames columns to ``f1..fn`` and keeps the
        original names for display (duplicates allowed); otherwise column
        names are the IDs.  Columns of unsupported types are rejected.
        """
        columns = df.columns
        display = list(names) if names is not None else list(columns)
        if len(display) != len(columns):
            raise DatasetError("names must have one entry per column")
        if positional_ids:
            ids = [f"f{i + 1}" for i in range(len(columns))]
            df = df.toDF(*ids)
        else:
            ids = list(columns)
        meanings = meanings or {}
        fields = tuple(
            Field(id=i, name=str(n), dtype=logical_dtype(df.schema[i].dataType), meaning=meanings.get(i, ""))
            for i, n in zip(ids, display)
        )
        warnings = ()
        if len(set(display)) != len(display):
            warnings = ("some headers repeat; the fields differ by their IDs",)
        return cls(df=df, fields=fields, source=source, warnings=warnings)

    # ---- lookups --------------------------------------------------------
    @property
    def ids(self) -> list[str]:
        return [f.id for f in self.fields]

    def field(self, field_id: str) -> Field:
        for f in self.fields:
            if f.id == field_id:
                return f
        raise DatasetError(f"Unknown field ID: {field_id}")

    def dtype(self, field_id: str) -> str:
        return self.field(field_id).dtype

    def resolve(self, ref: str | None) -> str | None:
        """An ID stays an ID; a unique exact display name resolves to its ID.

        Ambiguous or unknown names are returned unchanged so validation
        rejects them with the usual message.
        """
        if ref is None or ref in self.ids:
            return ref
        matches = [f.id for f in self.fields if f.name == ref]
        return matches[0] if len(matches) == 1 else ref

    def labels(self) -> dict[str, str]:
        return {f.id: f.name for f in self.fields}

    def with_frame(self, df: DataFrame, transform: dict | None = None, **changes) -> "Dataset":
        transforms = self.transforms + ((transform,) if transform else ())
        return replace(self, df=df, transforms=transforms, **changes)

    def metadata(self) -> dict:
        """JSON-safe description (no DataFrame, no private paths)."""
        return {
            "schema_version": "1.0",
            "source": self.source,
            "fields": [f.__dict__.copy() for f in self.fields],
            "warnings": list(self.warnings),
            "transforms": [dict(t) for t in self.transforms],
        }
