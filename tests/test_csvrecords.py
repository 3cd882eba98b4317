from __future__ import annotations

import csv
import io

from hypothesis import given, settings
from hypothesis import strategies as st

from answerlab.config import RAW_COLUMNS
from answerlab.operators import csvrecords as C

GOOD = {"Date received": "2020-02-29", "Consumer complaint narrative": "a, \"b\"\nc", "Complaint ID": " 12345678 "}


def line(end: str = "", **over) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow([(GOOD | over).get(c, "x") for c in RAW_COLUMNS])
    return out.getvalue() + end


def test_diagnoses_first_reason():
    assert C.diagnose(line())[0] is None
    assert all(C.diagnose(line(e))[0] is None for e in ("\n", "\r", "\r\n"))
    assert C.diagnose(line("\n\n"))[0] == "quoting"
    assert C.diagnose('a"b,' + line())[0] == "quoting"
    assert C.diagnose('"a" ,' + line())[0] == "quoting"
    assert C.diagnose("y," + line())[0] == "column_count"
    assert C.diagnose("")[0] == "column_count" and C.diagnose(None)[0] == "column_count"
    assert C.diagnose(line(**{"Complaint ID": "1234567"}))[0] == "complaint_id"
    assert C.diagnose(line(**{"Complaint ID": "١2345678"}))[0] == "complaint_id"
    for bad in ("2021-02-29", "13/01/2020", "2020-1-01", "0000-01-01", ""):
        assert C.diagnose(line(**{"Date received": bad}))[0] == "date_received"
    for ok in ("02/29/20", " 12/31/1999 ", "1066-10-14"):
        assert C.diagnose(line(**{"Date received": ok}))[0] is None
    for bad in ("a�", "a\x7f", "a\x00", "a\x1f"):
        assert C.diagnose(line(**{"Consumer complaint narrative": bad}))[0] == "narrative"
    assert C.diagnose(line(**{"Consumer complaint narrative": ""}))[0] is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab",\n\r ', max_size=6), min_size=1, max_size=4), st.booleans())
def test_reads_what_a_csv_writer_wrote(fields, quote_all):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL if quote_all or fields == [""] else csv.QUOTE_MINIMAL, lineterminator="\r\n").writerow(fields)
    assert C.split_record(out.getvalue()) == fields


def test_blocks_equal_strict_reading(spark):
    rows = []
    for i in range(700):
        over = {"Complaint ID": "bad"} if i % 97 == 3 else {"Date received": "02/30/2020"} if i % 101 == 5 else {}
        raw = line("\r\n" if i % 2 else "", **over)
        if i % 150 == 7:
            raw = raw.replace("x", 'x"y', 1)
        if i == 11:
            raw = None
        rows.append((i, raw, "clash"))
    df = spark.createDataFrame(rows + rows[:3], "record_id long, raw string, reason string")
    got = C.parse_records(df, "record_id", "raw", block=64)
    want = {(i, C.diagnose(r)[0]) for i, r, _ in rows}
    assert {(r["record_id"], r["reason"]) for r in got.collect()} == want
    assert got.count() == 703
    one = C.valid_records(got).where("record_id = 1").first()
    assert one["Complaint ID"] == " 12345678 " and one["Consumer complaint narrative"] == GOOD["Consumer complaint narrative"]
    assert C.rejected_records(got, "record_id").where("record_id = 11").first()["reason"] == "column_count"


def test_halving_isolates_the_failing_records():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 1000):
        for share in (0.0, 0.02, 0.5, 1.0):
            fails = rng.random(n) < share
            assert C.failing(fails) == np.flatnonzero(fails).tolist()


def test_bulk_path_agrees_with_strict_reading_on_odd_records():
    import pyarrow as pa

    rows = [line(), line("\r"), line("\n\n"), "", None, ",".join("x" * 18), line(**{"Issue": "a\r\nb"}), line(**{"Issue": ""}), "\n" + line(), line() + ",y", '"' + line()]
    rows += [line(**{"Date received": d}) for d in ("02/29/21", "02/29/20", "2020-02-30", "1/02/2020", "0000-01-01")]
    got = [r for b in C._load(pa.array(range(len(rows))), pa.array(rows, pa.string()), RAW_COLUMNS) for r in b.to_pylist()]
    assert sorted(r["key"] for r in got) == list(range(len(rows)))
    for r in got:
        reason, fields = C.diagnose(rows[r["key"]])
        assert r["reason"] == reason and [r[c] for c in RAW_COLUMNS] == (fields or [None] * 18)


def test_empty_table(spark):
    df = spark.createDataFrame([], "record_id long, raw string")
    assert C.parse_records(df, "record_id", "raw").count() == 0
