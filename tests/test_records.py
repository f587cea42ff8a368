"""Record starts, numbers and faults of delimited text, against Python's csv reader."""

import csv
import io
import os
import random

import pytest

from planwise.sources.delimited import IngestError, faulty_rows, read_delimited
from planwise.sources.records import open_after, read_records


@pytest.fixture()
def small_splits(spark):
    """Input splits of some 400 bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "400", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _write(folder, name, rows, end="\n", bom=""):
    os.makedirs(folder, exist_ok=True)
    text = io.StringIO()
    csv.writer(text, lineterminator=end).writerows(rows)
    with open(os.path.join(folder, name), "w", encoding="utf-8", newline="") as out:
        out.write(bom + text.getvalue())


def _cells(rng, n):
    cell = lambda: rng.choice(["a", "", 'say "hi"', "line\nbreak", "x,y", '"', "two\n\nbreaks\n", "\r\n", 'q"q', "word " * rng.randrange(40)])
    return [[str(k), cell(), cell()] for k in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_equal_the_csv_reader(spark, tmp_dir, small_splits, end):
    rng = random.Random(4)
    want = {}
    for name in ("a.csv", "b.csv"):
        rows = [["id", "t", "u"], *_cells(rng, 150), ["150", "long\n" * 500, "spans splits"], *_cells(rng, 20)]
        _write(tmp_dir, name, rows, end)
        want[name] = rows
    records, unclosed = read_records(spark, tmp_dir)
    assert records.rdd.getNumPartitions() > 20 and unclosed.collect() == []
    got = {(r["_file"].rsplit("/", 1)[-1], r["_row"]): next(csv.reader(io.StringIO(r["value"], newline=""))) for r in records.collect()}
    assert got == {(name, n): row for name, rows in want.items() for n, row in enumerate(rows, 1)}
    cells = read_delimited(spark, tmp_dir, multiline=True).df.collect()
    assert sorted((tuple(r) for r in cells), key=str) == sorted((tuple(c or None for c in row) for rows in want.values() for row in rows[1:]), key=str)


def test_quotes_open_only_at_a_cells_start():
    rng, opening = random.Random(8), b',"'
    for _ in range(3000):
        text = "".join(rng.choice('a,"') for _ in range(rng.randrange(12)))
        for inside in (False, True):
            state = "quoted" if inside else "start"
            k = 0
            while k < len(text):
                c = text[k]
                if state == "start":
                    state = "quoted" if c == '"' else "start" if c == "," else "plain"
                elif state == "quoted" and c == '"':
                    if text[k + 1:k + 2] == '"':
                        k += 1
                    else:
                        state = "plain"
                elif state == "plain" and c == ",":
                    state = "start"
                k += 1
            assert open_after(text.encode(), inside, opening) == (state == "quoted"), (text, inside)


def test_faults_are_named_by_row(spark, tmp_dir, small_splits):
    rows = [["title"], ["id", "t"], *[[str(k), f"line\nbreak {k}"] for k in range(60)]]
    rows[40] = ["38", "x", "too many"]
    _write(tmp_dir, "a.csv", rows)
    with pytest.raises(IngestError, match=r"1 rows do not have 2 columns.*row 41 of a\.csv"):
        read_delimited(spark, tmp_dir, header_row=2, multiline=True)
    found = [(r["file"].rsplit("/", 1)[-1], r["row"], r["fault"]) for r in faulty_rows(spark, tmp_dir, header_row=2).collect()]
    assert found == [("a.csv", 41, "ragged")]
    plain = os.path.join(tmp_dir, "plain")
    os.makedirs(plain)
    with open(os.path.join(plain, "p.csv"), "wb") as out:
        out.write(b"a,b\n" + b"1,2\n" * 300 + b"3\n\n" + b"4,\xff\n")
    assert sorted((r["row"], r["fault"]) for r in faulty_rows(spark, plain).collect()) == [(302, "ragged"), (303, "blank"), (304, "undecodable")]
    with pytest.raises(IngestError, match=r"row 302 of p\.csv"):
        read_delimited(spark, plain)


def test_header_beyond_the_first_split(spark, tmp_dir, small_splits):
    rows = [["note " * 30] for _ in range(20)] + [["id", "t"]] + [[str(k), "x"] for k in range(50)]
    _write(tmp_dir, "a.csv", rows)
    ds = read_delimited(spark, tmp_dir, header_row=21)
    assert ds.df.count() == 50 and [f.name for f in ds.fields] == ["id", "t"]
    with pytest.raises(IngestError, match="no file has a row 99"):
        read_delimited(spark, tmp_dir, header_row=99)


def test_unclosed_quotes_are_named(spark, tmp_dir, small_splits):
    with open(os.path.join(tmp_dir, "a.csv"), "w") as out:
        out.write("id,t\n" + "1,x\n" * 200 + '2,"never closed\n' + "3,y\n" * 200)
    with pytest.raises(IngestError, match=r"row 202 of a\.csv opens quotes"):
        read_delimited(spark, tmp_dir, multiline=True)


def test_the_first_pass_runs_once(spark, tmp_dir, small_splits):
    _write(tmp_dir, "a.csv", [["id", "t"], *[[str(i), "line\nline"] for i in range(50)]], "\n")
    records, _ = read_records(spark, tmp_dir)
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("] text") == 2  # whole and crossing records; the splits' states are stored
