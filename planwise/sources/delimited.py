"""Strict ingestion of delimited text (CSV/TSV/TXT) and pasted tables.

Every cell is read as text under positional IDs ``f1..fn``; empty cells are
null; a row whose width differs from the header's, a blank line, or an
undecodable byte rejects the whole import (nothing is imported), and the
message names the first such row by its number in its file, the header
included.  Files are split across tasks, also with ``multiline=True``, which
finds the records where quoted cells contain line breaks.
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwise.dataset import Dataset, DatasetError
from planwise.operators.profile import inference_aggregates, inference_inputs, inference_rows, type_dataset
from planwise.sources.records import is_utf8, read_with_row

BLANK = "_blank_line"
CORRUPT = "_corrupt_record"
INVALID = "_invalid_text"
REPLACEMENT_CHAR = "�"


class IngestError(DatasetError):
    pass


def _delimiter(path: str, delimiter: str | None) -> str:
    delim = delimiter or ("\t" if path.lower().endswith(".tsv") else ",")
    if len(delim) != 1:
        raise IngestError("a delimiter is a single character")
    return delim


def _reader(spark: SparkSession, delim: str, encoding: str):
    return (spark.read.option("sep", delim).option("encoding", encoding).option("quote", '"')
            .option("escape", '"').option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).option("nullValue", "").option("emptyValue", ""))


def _one_header(headers: list[str], delim: str) -> list[str | None]:
    """The header that all files share; a file with another one rejects the import."""
    if len(headers) > 1:
        raise IngestError(f"files have different headers: {headers[0]!r} and {headers[1]!r}")
    head = _split_header(headers[0], delim) if headers else []
    if head:  # a byte-order mark is not part of the first name
        head[0] = (head[0] or "").removeprefix("\ufeff") or None
    if not head or all(v is None for v in head):
        raise IngestError("the header has no names")
    return head


def _scanned_lines(spark: SparkSession, path: str, encoding: str):
    """Headers of all files (two at most), blank and invalid lines, in one pass."""
    lines = spark.read.option("encoding", encoding).text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_line"))
    first = F.min_by(F.when(F.col("_start") == 0, F.col("value")), F.when(F.col("_start") == 0, F.col("_line")))
    if not is_utf8(encoding):
        first = first.cast("binary")
    files = lines.groupBy("_file").agg(first.alias("head"), F.count_if(F.trim(F.col("value")) == "").alias("blank"),
                                       F.count_if(~F.is_valid_utf8("value")).alias("bad"))
    return files.agg(F.min("head").alias("head"), F.max("head").alias("other"), F.coalesce(F.sum("blank"), F.lit(0)).alias("blank"),
                     F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()


def _parsed(records: DataFrame, schema: str, delim: str) -> DataFrame:
    """Cells of records (_file, _row, value), with the record marked where it is ragged, blank or not valid text."""
    options = {"sep": delim, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true",
               "columnNameOfCorruptRecord": CORRUPT, "nullValue": "", "emptyValue": ""}
    return records.select("_file", "_row", F.from_csv(F.col("value"), schema, options).alias("_r"),
                          (F.trim(F.col("value")) == "").alias(BLANK),
                          (~F.is_valid_utf8("value") | F.col("value").contains(REPLACEMENT_CHAR)).alias(INVALID)
                          ).select("_file", "_row", "_r.*", BLANK, INVALID)


def faulty_rows(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str = "utf-8",
                header_row: int = 1) -> DataFrame:
    """(file, row, fault, record): every ragged, blank or undecodable record below the header, by its number in its file.

    ``fault`` is ``ragged``, ``blank`` or ``undecodable``; ``file`` is the path Spark read it from.
    """
    delim = _delimiter(path, delimiter)
    records, _, heads = read_with_row(spark, path, delim, encoding, header_row)
    heads = heads.select("value").distinct().limit(2).collect()
    ids = [f"f{i + 1}" for i in range(len(_one_header(sorted(r["value"] for r in heads), delim)))]
    schema = ", ".join(f"`{i}` string" for i in ids) + f", `{CORRUPT}` string"
    rows = _parsed(records.where(F.col("_row") > header_row), schema, delim)
    fault = (F.when(F.col(INVALID), "undecodable").when(F.col(BLANK), "blank").when(F.col(CORRUPT).isNotNull(), "ragged"))
    return (rows.select(F.col("_file").alias("file"), F.col("_row").alias("row"), fault.alias("fault"), F.col(CORRUPT).alias("record"))
            .where("fault IS NOT NULL"))


def _first_fault(spark: SparkSession, path: str, delim: str, encoding: str, header_row: int, fault: str) -> str:
    """Where a rejected import is wrong first, for its message."""
    row = (faulty_rows(spark, path, delim, encoding, header_row).where(F.col("fault") == fault)
           .agg(F.min(F.struct("file", "row")).alias("at")).first()["at"])
    return f"the first is row {row['row']} of {row['file'].rsplit('/', 1)[-1]}" if row else "counted by lines"


def _split_header(line: str, delim: str) -> list[str | None]:
    """Cells of the one header line (driver-side: a single line)."""
    cells = next(csv.reader([line], delimiter=delim, quotechar='"', doublequote=True), [])
    return [c if c != "" else None for c in cells]


def read_delimited(
    spark: SparkSession,
    path: str,
    delimiter: str | None = None,
    encoding: str = "utf-8",
    header_row: int = 1,
    multiline: bool = False,
    max_rows: int | None = None,
    check_blank_lines: bool = True,
    infer: bool = False,
    overrides: dict[str, dict] | None = None,
) -> Dataset:
    """Strict import of a delimited file or folder.

    ``infer=True`` also types the columns; the inference counts are computed
    in the same aggregate as the validation counts (one scan of the data).
    """
    if header_row < 1:
        raise IngestError("header_row counts from 1")
    delim = _delimiter(path, delimiter)
    strict = is_utf8(encoding)
    by_record = multiline or header_row > 1
    if by_record:
        records, unclosed, heads = read_with_row(spark, path, delim, encoding, header_row)
        heads = heads.select("value").distinct().limit(2).collect()
        headers = sorted(r["value"] for r in heads)
        if multiline and (open_ := unclosed.first()):
            raise IngestError(f"row {open_['_row']} of {open_['_file'].rsplit('/', 1)[-1]} opens quotes that nothing closes")
        if not headers:
            raise IngestError(f"no file has a row {header_row} to take the header from")
    else:  # UTF-8 lines come as the bytes they are, so they can be checked
        text = _scanned_lines(spark, path, encoding)
        headers = sorted({h if strict else bytes(h).decode(encoding, "replace") for h in (text["head"], text["other"]) if h is not None})
    head = _one_header(headers, delim)
    names = [v if v is not None else "Unnamed" for v in head]
    ids = [f"f{i + 1}" for i in range(len(names))]
    schema = ", ".join(f"`{i}` string" for i in ids) + f", `{CORRUPT}` string"
    if by_record:
        df = _parsed(records.filter(F.col("_row") > header_row), schema, delim).drop("_file", "_row")
    else:
        df = (_reader(spark, delim, encoding).schema(schema).option("header", True).csv(path)
              .withColumns({BLANK: F.lit(False), INVALID: F.lit(False)}))
    bad_text = F.col(INVALID)
    for i in [] if strict or by_record else ids:  # other encodings are decoded by the reader, which marks what it cannot read
        bad_text = bad_text | F.coalesce(F.col(i).contains(REPLACEMENT_CHAR), F.lit(False))
    kept = ~F.col(BLANK)
    validation = [
        F.count_if(kept).alias("rows"),
        F.count_if(F.col(BLANK)).alias("blank_lines"),
        F.count_if(F.col(CORRUPT).isNotNull() & kept).alias("ragged"),
        F.first(F.when(kept, F.col(CORRUPT)), ignorenulls=True).alias("example"),
        F.count_if(bad_text).alias("undecodable"),
        F.count_if(F.coalesce(*[F.col(i) for i in ids]).isNull()).alias("empty"),
    ]
    scanned = df.select("*", *inference_inputs(ids)) if infer else df
    counts_df = scanned.agg(*validation, *(inference_aggregates(ids) if infer else []))
    checks = counts_df.first()

    def where(fault: str) -> str:
        return _first_fault(spark, path, delim, encoding, header_row, fault)
    if checks["ragged"]:
        hint = "" if multiline else " (set multiline=True if quoted fields contain line breaks)"
        raise IngestError(f"{checks['ragged']} rows do not have {len(ids)} columns, e.g. "
                          f"{checks['example']!r}; {where('ragged')}; fix the delimiter{hint}")
    # The file reader drops blank lines and replaces bad bytes silently, so both are counted on the text.
    undecodable = checks["undecodable"] if by_record or not strict else text["bad"]
    if undecodable:
        raise IngestError(f"{undecodable} rows are not valid {encoding}; {where('undecodable')}")
    if check_blank_lines and (checks["blank_lines"] if by_record else text["blank"]):
        raise IngestError(f"blank lines have no cells; remove them: {where('blank')}")
    df = df.filter(kept).drop(BLANK, INVALID)
    if max_rows is not None and checks["rows"] > max_rows:
        raise IngestError(f"{checks['rows']} rows exceed the limit of {max_rows}; nothing was imported")
    ds = Dataset.from_frame(df.drop(CORRUPT), names=names, positional_ids=False, source=path)
    ds = ds.with_frame(ds.df, {"operation": "import", "source": path, "header_row": header_row})
    if not infer:
        return ds
    # The decisions are derived from the one-row counts already collected.
    one_row = spark.createDataFrame([checks], counts_df.schema)
    inferred = {r["field"]: r for r in inference_rows(one_row, ids).collect()}
    return type_dataset(ds, overrides, inferred=inferred)


def read_pasted(spark: SparkSession, text: str) -> Dataset:
    """A pasted tab-separated table (small by nature: it arrives in the driver)."""
    lines = text.splitlines()
    if not lines or not lines[0].strip():
        raise IngestError("the header has no names")
    blank = next((n for n, line in enumerate(lines, start=1) if line == ""), None)
    if blank:
        raise IngestError(f"row {blank} is blank: it has no cells")
    rows = [line.split("\t") for line in lines]
    names, body = rows[0], rows[1:]
    for n, row in enumerate(body, start=2):
        if len(row) != len(names):
            raise IngestError(f"row {n} has {len(row)} cells, the header {len(names)}")
    ids = [f"f{i + 1}" for i in range(len(names))]
    df = spark.createDataFrame([[v if v != "" else None for v in r] for r in body],
                               ", ".join(f"`{i}` string" for i in ids))
    return Dataset.from_frame(df, names=names, source="pasted")
