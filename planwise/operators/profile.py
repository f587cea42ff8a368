"""Type inference, strict casts, column profile, duplicate count, fingerprint.

Inference and profiling each run as ONE aggregate job over all columns
(partial aggregation, no driver-side scan of rows).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planwise.dataset import Dataset, DatasetError, Field
from planwise.functions.exprs import compact_key, quote_id, sql_literal

# Number grammar accepted by the reference's numeric parser (decimal or
# scientific, optional sign, surrounding blanks; inf/infinity parse but are
# rejected later by the finiteness check).  Java's parser also accepts forms
# such as "1d" or hex floats, which must not count as numbers here.
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*)|(\.\d+))([eE][+-]?\d+)?\s*$|^\s*[+-]?(inf|infinity)\s*$"
DATE_PREFIX = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}"
# Candidate timestamp layouts, tried in order; the first that parses every
# non-null value of a column wins.
DATE_FORMATS = (
    "yyyy-M-d",
    "yyyy/M/d",
    "yyyy-M-d H:m",
    "yyyy-M-d H:m:s",
    "yyyy-M-d H:m:s.SSSSSS",
    "yyyy-M-d'T'H:m:s",
    "yyyy-M-d'T'H:m:s.SSSSSS",
    "yyyy/M/d H:m",
    "yyyy/M/d H:m:s",
    "yyyy-M-d'T'H:m",
    "yyyy-M-d'T'H:mXXX",
    "yyyy-M-d'T'H:m:sXXX",
    "yyyy-M-d'T'H:m:s.SSSSSSXXX",
    "yyyy-M-d H:m:sXXX",
    "yyyy-M-d h:m a",
    "yyyy-M-d h:m:s a",
    "yyyy/M/d h:m a",
)
# Further layouts that a cast to date tries, though inference leaves such
# columns as text; where day and month could change places, the month is first.
CAST_DATE_FORMATS = ("M/d/yyyy", "M/d/yyyy H:m", "M/d/yyyy H:m:s", "yyyyMMdd", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy",
                     "d MMMM yyyy")
# The texts that a boolean cast accepts.
BOOLEAN_TEXT = {"true": True, "false": False, "1": True, "0": False}


def _number(c: Column) -> Column:
    """Text -> double under the reference grammar (null when not a number)."""
    return F.when(c.rlike(NUMBER_PATTERN), F.trim(c).try_cast("double"))


def _layout_key(fmt: str) -> str:
    """The shape of the texts a layout parses: each run of pattern letters
    becomes ``9``, quoted and punctuation characters stay as they are
    (``yyyy-M-d H:m`` -> ``9-9-9 9:9``).  A text can only parse in a layout
    whose key equals its own ``_value_layout``."""
    out, i = [], 0
    while i < len(fmt):
        ch = fmt[i]
        if ch == "'":
            j = fmt.index("'", i + 1)
            out.append(fmt[i + 1:j].upper())
            i = j + 1
        elif ch.isalpha():
            while i < len(fmt) and fmt[i] == ch:
                i += 1
            out.append({"X": "X", "a": "A"}.get(ch, "9"))
        else:
            out.append(ch)
            i += 1
    return "".join(out)


def _value_layout(c: Column) -> Column:
    """A text's shape in the same alphabet: digit runs become ``9``, a zone
    after a time ``X``, a half of the day ``A``."""
    zoned = F.regexp_replace(F.trim(c), r"(:\d{1,2}(?:\.\d+)?)(?:[Zz]|[+-]\d{2}:\d{2})$", "$1X")
    return F.upper(F.regexp_replace(F.regexp_replace(zoned, r"(?i)(\d )[ap]m$", "$1A"), r"\d+", "9"))


def _parse(c: Column, fmt: str) -> Column:
    return F.try_to_timestamp(F.trim(c), F.lit(fmt)).cast("timestamp_ntz")


def _date(c: Column, fmt: str) -> Column:
    """Text -> timestamp in layout ``fmt`` (null when it does not parse).

    The parse only runs on texts of the layout's shape: a failed
    ``try_to_timestamp`` is an exception inside the JVM, and probing every
    layout on every value that way costs far more than one shape test.
    """
    return F.when(_value_layout(c) == F.lit(_layout_key(fmt)), _parse(c, fmt))


def inference_inputs(string_cols: list[str]) -> list[Column]:
    """Per-row parse results the inference counts read, one column each.

    Computed once per row in a projection (the number parse is counted twice
    and the date prefix guards every layout); add them with
    ``select("*", *inference_inputs(cols))`` before ``inference_aggregates``.
    """
    out = []
    for i, c in enumerate(string_cols):
        col = F.col(c)
        pre = col.rlike(DATE_PREFIX)
        out += [_number(col).alias(f"_num{i}"), pre.alias(f"_pre{i}"),
                F.when(pre, _value_layout(col)).alias(f"_lay{i}")]
    return out


def inference_aggregates(string_cols: list[str]) -> list[Column]:
    """Per-column counts that decide each text column's dtype, over the
    columns of ``inference_inputs``.

    Usable inside any other aggregate over the same rows (ingestion fuses
    them with its validation counts so an import scans the file once).
    """
    aggs = []
    for i, c in enumerate(string_cols):
        col, num, pre = F.col(c), F.col(f"_num{i}"), F.col(f"_pre{i}")
        aggs += [
            F.count(col).alias(f"n{i}"),
            F.count(num).alias(f"num{i}"),
            F.count_if(pre).alias(f"pre{i}"),
            F.count_if(F.abs(num) == float("inf")).alias(f"inf{i}"),
        ]
        # A date column needs every value to match the prefix, so layouts are
        # only probed on values that do (parsing is the expensive part).
        lay = F.col(f"_lay{i}")
        aggs += [F.count(F.when(lay == F.lit(_layout_key(fmt)), _parse(col, fmt))).alias(f"d{i}_{k}")
                 for k, fmt in enumerate(DATE_FORMATS)]
    return aggs


def inference_rows(counts: DataFrame, string_cols: list[str]) -> DataFrame:
    """One row per text column from the counts of ``inference_aggregates``:
    (field, nonnull, numeric, dtype, date_format, mixed, infinite)."""
    rows = []
    for i, c in enumerate(string_cols):
        n, num, pre = F.col(f"n{i}"), F.col(f"num{i}"), F.col(f"pre{i}")
        fmt = F.lit(None).cast("string")
        for k in reversed(range(len(DATE_FORMATS))):
            fmt = F.when(F.col(f"d{i}_{k}") == n, F.lit(DATE_FORMATS[k])).otherwise(fmt)
        is_num = (n > 0) & (num == n)
        is_date = (n > 0) & ~is_num & (pre == n) & fmt.isNotNull()
        dtype = F.when(is_num, "number").when(is_date, "date").otherwise("string")
        rows.append(F.struct(
            F.lit(c).alias("field"),
            n.alias("nonnull"),
            num.alias("numeric"),
            dtype.alias("dtype"),
            F.when(is_date, fmt).alias("date_format"),
            ((num > 0) & (num < n) & ~is_date).alias("mixed"),
            F.col(f"inf{i}").alias("infinite"),
        ))
    return counts.select(F.inline(F.array(*rows)))


def infer_types(df: DataFrame) -> DataFrame:
    """Dtype decision per text column, from a single aggregate over the table."""
    string_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not string_cols:
        raise DatasetError("no text columns to infer")
    counts = df.select(*string_cols, *inference_inputs(string_cols)).agg(*inference_aggregates(string_cols))
    return inference_rows(counts, string_cols)


def strict_cast(df: DataFrame, column: str, dtype: str, name: str | None = None,
                date_format: str | None = None) -> Column:
    """Checked conversion of a text column; raises with up to 3 bad samples.

    The check is one filtered scan of that column that stops at the third
    bad value; the conversion itself is a lazy expression.
    """
    c = F.col(column)
    label = name or column
    if dtype == "string":
        return c.cast("string").alias(column)
    if dtype == "number":
        value = _number(c)
        bad = df.filter(c.isNotNull() & value.isNull()).select(column).limit(3).collect()
        if bad:
            raise DatasetError(f"{label}: not a number: {[r[0] for r in bad]}")
        if df.filter(F.abs(value) == float("inf")).limit(1).count():
            raise DatasetError(f"{label}: holds an infinite number")
        return F.nanvl(value, F.lit(None).cast("double")).alias(column)
    if dtype == "date":
        formats = [date_format] if date_format else [*DATE_FORMATS, *CAST_DATE_FORMATS]
        read = lambda f: _date(c, f) if f in DATE_FORMATS else _parse(c, f)
        counts = df.agg(F.count(c).alias("n"), *[F.count(read(f)).alias(f"d{k}") for k, f in enumerate(formats)]).first()
        chosen = next((f for k, f in enumerate(formats) if counts[f"d{k}"] == counts["n"]), None)
        if chosen is None:
            bad = df.filter(c.isNotNull() & F.coalesce(*[read(f) for f in formats]).isNull()).select(column).limit(3).collect()
            raise DatasetError(f"{label}: not a date: {[r[0] for r in bad]}")
        return read(chosen).alias(column)
    if dtype == "boolean":
        lookup = F.create_map(*[x for k, v in BOOLEAN_TEXT.items() for x in (F.lit(k), F.lit(v))])
        value = lookup[F.lower(F.trim(c.cast("string")))]
        bad = df.filter(c.isNotNull() & value.isNull()).select(column).limit(3).collect()
        if bad:
            raise DatasetError(f"{label}: not one of {sorted(BOOLEAN_TEXT)}: {[r[0] for r in bad]}")
        return value.alias(column)
    raise DatasetError(f"unknown dtype {dtype!r}")


def type_dataset(ds: Dataset, overrides: dict[str, dict] | None = None, inferred: dict | None = None) -> Dataset:
    """Infer dtypes of text columns (one job), apply overrides, cast.

    Inferred types can never fail their cast; overridden ones are checked.
    ``inferred`` passes decisions already computed (e.g. during ingestion).
    """
    overrides = overrides or {}
    unknown = set(overrides) - set(ds.ids)
    if unknown:
        raise DatasetError(f"Unknown field ID: {sorted(unknown)[0]}")
    df = ds.df
    if inferred is None:
        inferred = {r["field"]: r for r in infer_types(df).collect()} if any(
            isinstance(f.dataType, T.StringType) for f in df.schema.fields) else {}
    cols, fields, warnings = [], [], list(ds.warnings)
    for f in ds.fields:
        info = inferred.get(f.id)
        dtype = info["dtype"] if info else f.dtype
        if info and info["mixed"]:
            warnings.append(f"{f.name}: mixed numeric/text values; kept as text")
        requested = overrides.get(f.id, {})
        target = requested.get("dtype", dtype)
        if info is None and target == f.dtype:
            cols.append(F.col(f.id))
        elif info is not None and target == dtype:
            if dtype == "number" and info["infinite"]:
                raise DatasetError(f"{f.name}: infinite numeric values are not supported")
            if dtype == "number":
                cols.append(F.nanvl(_number(F.col(f.id)), F.lit(None).cast("double")).alias(f.id))
            elif dtype == "date":
                cols.append(_date(F.col(f.id), info["date_format"]).alias(f.id))
            else:
                cols.append(F.col(f.id))
        else:
            cols.append(strict_cast(df, f.id, target, f.name))
        fields.append(Field(f.id, f.name, target, requested.get("meaning", f.meaning)))
    out = df.select(*cols)
    return ds.with_frame(out, {"operation": "types", "overrides": overrides},
                         fields=tuple(fields), warnings=tuple(dict.fromkeys(warnings)))


def profile(ds: Dataset, approx: bool = False) -> DataFrame:
    """Per-field nulls, distinct non-null values and min/max text (number/date).

    Exact (default): one job whose branches each read ONE column, group it on
    its own values (a hot value collapses map-side to one row per task) and
    derive everything from the distinct values and their counts - nulls are
    the count of the null group, min/max are over the distinct values.  So
    each column is read once and only narrow distinct values (long texts as
    their SHA-256) are shuffled
    (a single aggregate with one ``count(DISTINCT)`` per column would have
    Spark copy every row once per column before its shuffle).
    ``approx=True`` computes HyperLogLog distinct counts in a single
    aggregate instead (bounded memory for very wide or very large tables).
    """
    if approx:
        return _profile_approx(ds)
    branches, key = [], lambda c: compact_key(c, ds.df.schema)
    for f in ds.fields:
        minmax = (["CAST(min(v) AS STRING) AS min", "CAST(max(v) AS STRING) AS max"]
                  if f.dtype in ("number", "date") else ["CAST(NULL AS STRING) AS min", "CAST(NULL AS STRING) AS max"])
        branches.append(
            ds.df.selectExpr(f"{key(f.id)} AS v").groupBy("v").agg(F.expr("count(1) AS n"))
            .selectExpr(f"{sql_literal(f.id)} AS field", f"{sql_literal(f.name)} AS name",
                        f"{sql_literal(f.dtype)} AS dtype",
                        "CAST(coalesce(sum(CASE WHEN v IS NULL THEN n END), 0) AS BIGINT) AS nulls",
                        "CAST(count(v) AS BIGINT) AS unique", *minmax))
    return reduce(DataFrame.unionByName, branches)


def _profile_approx(ds: Dataset) -> DataFrame:
    aggs = []
    for i, f in enumerate(ds.fields):
        c = quote_id(f.id)
        aggs += [f"count_if({c} IS NULL) AS nulls{i}", f"approx_count_distinct({c}) AS unique{i}"]
        if f.dtype in ("number", "date"):
            aggs += [f"CAST(min({c}) AS STRING) AS min{i}", f"CAST(max({c}) AS STRING) AS max{i}"]
        else:
            aggs += [f"CAST(NULL AS STRING) AS min{i}", f"CAST(NULL AS STRING) AS max{i}"]
    # SQL text keeps plan building to a few driver round trips for any width.
    stats = ds.df.selectExpr(*aggs)
    rows = ", ".join(
        f"{sql_literal(f.id)}, {sql_literal(f.name)}, {sql_literal(f.dtype)}, "
        f"CAST(nulls{i} AS BIGINT), CAST(unique{i} AS BIGINT), min{i}, max{i}"
        for i, f in enumerate(ds.fields))
    return stats.selectExpr(f"stack({len(ds.fields)}, {rows}) AS (field, name, dtype, nulls, unique, min, max)")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows minus distinct rows (nulls compare equal), as a one-row frame.

    Exact duplicates collapse in the map-side partial aggregate, so a row
    repeated a billion times costs one shuffle record per task; long texts
    are compared and shuffled as their SHA-256.
    """
    keys = [f"{compact_key(c, df.schema)} AS _k{i}" for i, c in enumerate(df.columns)]
    return (df.selectExpr(*keys).groupBy(*[f"_k{i}" for i in range(len(keys))]).count()
            .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows")))


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive content fingerprint: row count, and sums of two parts of the rows' md5.

    A row is spelled out column by column as its position, and the length and
    text of its value or a mark for null, so that a value cannot move to
    another column or a null to another place unseen.  The count and the sums
    keep repeated rows from cancelling out; layout and partitioning play no part.
    """
    return with_checksum(df.selectExpr(f"{row_md5(df.columns)} AS _md5").agg(*md5_sums()))


def row_md5(columns: list[str]) -> str:
    """SQL text of the md5 of a row, spelled out column by column."""
    cell = lambda i, c: (f"concat('{i}', coalesce(concat('=', length(CAST({quote_id(c)} AS STRING)), ':', "  # noqa: E731
                         f"CAST({quote_id(c)} AS STRING)), '-'))")
    return "md5(CAST(concat(" + ", ".join(cell(i, c) for i, c in enumerate(columns)) + ") AS BINARY))" if columns else "''"


def md5_sums(md5: str = "_md5") -> list[Column]:
    """Aggregates that add up over any parts of a table: the rows, and the sums of two parts of their md5."""
    part = lambda start: f"sum(CAST(conv(substring({md5}, {start}, 15), 16, 10) AS DECIMAL(38, 0)))"
    return [F.count(F.lit(1)).alias("rows"),
            *[F.expr(f"coalesce({part(start)}, 0)").cast("decimal(38,0)").alias(name) for start, name in ((1, "sum_a"), (16, "sum_b"))]]


def with_checksum(sums: DataFrame) -> DataFrame:
    """The sums as text, and one checksum of them."""
    texts = sums.withColumns({c: F.col(c).cast("string") for c in ("sum_a", "sum_b")})
    return texts.select("*", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), "sum_a", "sum_b"), 256).alias("checksum"))
