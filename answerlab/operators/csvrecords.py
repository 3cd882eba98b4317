"""Rows that fail to parse: bulk columnar parsing with bisection of failing blocks.

Blocks of records take a fast path: one vectorised match of well-formed records of the right width, one columnar CSV parse of
these, vectorised checks of the validated columns.  A block that passes is loaded as it stands.  A block that fails is
halved until the failing records stand alone; what the checks found is kept as a running count, so a half is tested by two
lookups instead of another parse.  The records that stand alone are diagnosed, field by field, for the first reason that holds; the
rest of the block is loaded from the one parse.  If the columnar parser itself refuses a block, its halves are parsed again.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame

from answerlab.config import RAW_COLUMNS

_FIELD = r'(?:"[^"]*(?:""[^"]*)*"|[^",\r\n]*)'
#: The whole record of one more fields than ``{}``, at most one line end.  Used by RE2 on blocks.
_RECORD = r"\A{0}(?:,{0}){{{1}}}(?:\r\n|\n|\r)?\z"
_BAD_TEXT = "[\\x{FFFD}\\x{7F}\\x{00}-\\x{08}\\x{0B}\\x{0C}\\x{0E}-\\x{1F}]"
_BAD_TEXT_PY = re.compile("[�\x7f\x00-\x08\x0b\x0c\x0e-\x1f]")
_ID = re.compile(r"[0-9]{8}")
_DATES = (re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})"), re.compile(r"([0-9]{2})/([0-9]{2})/([0-9]{4}|[0-9]{2})"))
#: Lengths of the months, without leap days.
_MONTHS = np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])
_BLOCK = 4_096
REASONS = ("quoting", "column_count", "complaint_id", "date_received", "narrative")


def split_record(raw: str) -> list[str] | None:
    """Fields of one record read strictly, or None if its quoting is not well-formed."""
    if raw.endswith("\r\n"):
        raw = raw[:-2]
    elif raw.endswith(("\n", "\r")):
        raw = raw[:-1]
    fields, at, n = [], 0, len(raw)
    while True:
        if at < n and raw[at] == '"':
            at += 1
            parts = []
            while True:
                end = raw.find('"', at)
                if end < 0:
                    return None
                parts.append(raw[at:end])
                at = end + 1
                if at < n and raw[at] == '"':
                    parts.append('"')
                    at += 1
                    continue
                break
            fields.append("".join(parts))
        else:
            end = raw.find(",", at)
            end = n if end < 0 else end
            plain = raw[at:end]
            if '"' in plain or "\n" in plain or "\r" in plain:
                return None
            fields.append(plain)
            at = end
        if at == n:
            return fields
        if raw[at] != ",":
            return None
        at += 1


def real_date(text: str) -> tuple[int, int, int] | None:
    """(year, month, day) of YYYY-MM-DD, MM/DD/YYYY or MM/DD/YY, blanks around allowed; None if no real date.

    Two-digit years below 69 are of the 2000s, the others of the 1900s.
    """
    t = text.strip(" ")
    if m := _DATES[0].fullmatch(t):
        y, mo, d = map(int, m.groups())
    elif m := _DATES[1].fullmatch(t):
        mo, d, y = map(int, m.groups())
        if len(m[3]) == 2:
            y += 2000 if y < 69 else 1900
    else:
        return None
    if y < 1 or not 1 <= mo <= 12:
        return None
    last = int(_MONTHS[mo - 1]) + (mo == 2 and (y % 4 == 0 and y % 100 != 0 or y % 400 == 0))
    return (y, mo, d) if 1 <= d <= last else None


def diagnose(raw: str | None, columns: tuple[str, ...] = RAW_COLUMNS) -> tuple[str | None, list[str] | None]:
    """(first reason that holds or None, fields) of one record, read strictly."""
    fields = split_record("" if raw is None else raw)
    if fields is None:
        return "quoting", None
    if len(fields) != len(columns):
        return "column_count", None
    by = dict(zip(columns, fields))
    if not _ID.fullmatch(by["Complaint ID"].strip(" ")):
        return "complaint_id", None
    if real_date(by["Date received"]) is None:
        return "date_received", None
    if _BAD_TEXT_PY.search(by["Consumer complaint narrative"]):
        return "narrative", None
    return None, fields


def _real_dates(values: pa.Array) -> np.ndarray:
    """Which values are real dates, column-wise."""
    t = pc.utf8_trim(values, " ")
    parts = []
    for pattern in (
        r"\A(?P<y>[0-9]{4})-(?P<m>[0-9]{2})-(?P<d>[0-9]{2})\z",
        r"\A(?P<m>[0-9]{2})/(?P<d>[0-9]{2})/(?P<y>[0-9]{4}|[0-9]{2})\z",
    ):
        got = pc.extract_regex(t, pattern)
        parts.append({k: pc.cast(pc.struct_field(got, k), pa.int32()) for k in "ymd"} | {"short": pc.struct_field(got, "y")})
    y, m, d = (pc.fill_null(pc.coalesce(parts[0][k], parts[1][k]), 0).to_numpy(zero_copy_only=False) for k in "ymd")
    short = pc.fill_null(pc.less(pc.utf8_length(parts[1]["short"]), 4), False).to_numpy(zero_copy_only=False)
    y = np.where(short, y + np.where(y < 69, 2000, 1900), y)
    month = (m >= 1) & (m <= 12)
    leap = (m == 2) & ((y % 4 == 0) & (y % 100 != 0) | (y % 400 == 0))
    return (y >= 1) & month & (d >= 1) & (d <= _MONTHS[np.where(month, m, 1) - 1] + leap)


def _table(body: list[str], columns: tuple[str, ...]) -> pa.Table | None:
    """One columnar parse of some records without their line ends; None if the parser refuses."""
    data = ("\n".join(body) + "\n").encode()
    try:
        out = pacsv.read_csv(
            io.BytesIO(data),
            pacsv.ReadOptions(use_threads=False, block_size=len(data) + 1, column_names=list(columns)),
            pacsv.ParseOptions(newlines_in_values=True, ignore_empty_lines=False),
            pacsv.ConvertOptions(column_types={c: pa.string() for c in columns}, strings_can_be_null=False),
        ).combine_chunks()
    except pa.ArrowInvalid:
        return None
    return out if out.num_rows == len(body) else None


def _bulk(raws: pa.Array, columns: tuple[str, ...]) -> tuple[np.ndarray, list[tuple[np.ndarray, pa.Table]]]:
    """(which records fail, the parsed records as (record numbers, columns)) of a block."""
    well = pc.fill_null(pc.match_substring_regex(raws, _RECORD.format(_FIELD, len(columns) - 1)), False).to_numpy(zero_copy_only=False)
    fails = ~well
    body = pc.replace_substring_regex(raws.take(pa.array(np.flatnonzero(well))), r"(?:\r\n|\n|\r)\z", "").to_pylist()
    todo, done = [(np.flatnonzero(well), body)] if body else [], []
    while todo:
        at, body = todo.pop()
        got = _table(body, columns)
        if got is None:
            if len(at) == 1:
                fails[at] = True
            else:
                mid = len(at) // 2
                todo += [(at[mid:], body[mid:]), (at[:mid], body[:mid])]
            continue
        one = lambda name: got.column(name).combine_chunks()  # noqa: E731, B023
        ok = pc.match_substring_regex(pc.utf8_trim(one("Complaint ID"), " "), r"\A[0-9]{8}\z").to_numpy(zero_copy_only=False)
        ok = ok & ~pc.match_substring_regex(one("Consumer complaint narrative"), _BAD_TEXT).to_numpy(zero_copy_only=False)
        ok = ok & _real_dates(one("Date received"))
        fails[at[~ok]] = True
        done.append((at, got if ok.all() else got.filter(pa.array(ok))))
        done[-1] = (at[ok], done[-1][1])
    return fails, done


def failing(fails: np.ndarray) -> list[int]:
    """The failing records of a block, isolated by halving it; a half is tested by the running count of failures."""
    seen = np.concatenate(([0], np.cumsum(fails))).tolist()
    todo, out = [(0, len(fails))], []
    while todo:
        lo, hi = todo.pop()
        if seen[hi] == seen[lo]:
            continue  # this part of the block passes as a whole
        if hi - lo == 1:
            out.append(lo)
        else:
            mid = (lo + hi) // 2
            todo += [(mid, hi), (lo, mid)]
    return out


def _load(key: pa.Array, raws: pa.Array, columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    names = ["key", "reason", *columns]
    fails, parsed = _bulk(raws, columns)
    for at, block in parsed:
        if len(at):
            arrays = [block.column(c).combine_chunks() for c in columns]
            yield pa.RecordBatch.from_arrays([key.take(pa.array(at)), pa.nulls(len(at), pa.string()), *arrays], names)
    alone = failing(fails)
    if alone:
        found = [diagnose(raws[i].as_py(), columns) for i in alone]
        cells = [[None if f is None else f[j] for _, f in found] for j in range(len(columns))]
        yield pa.RecordBatch.from_arrays(
            [key.take(pa.array(alone)), pa.array([r for r, _ in found], pa.string()), *(pa.array(c, pa.string()) for c in cells)], names
        )


def parse_records(
    table: DataFrame, key_col: str, raw_col: str, columns: tuple[str, ...] = RAW_COLUMNS, block: int = _BLOCK
) -> DataFrame:
    """One row per record: ``(key_col, reason, the named columns)``; ``reason`` is null for valid records.

    Rejected records have the first reason that holds (see ``REASONS``) and null columns.  A null record is
    read as an empty one, so it fails by 'column_count'.  Repeated records stay repeated; an empty table gives
    no rows; other columns of the input are ignored, so their names cannot clash.
    """
    kind = table.schema[key_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, raws = batch.column(0), batch.column(1)
            if not pa.types.is_string(raws.type):
                raws = raws.cast(pa.string())
            for lo in range(0, batch.num_rows, block):
                yield from _load(key.slice(lo, block), raws.slice(lo, block), columns)

    out = f"`key` {kind}, `reason` string, " + ", ".join(f"`{c}` string" for c in columns)
    return table.select(key_col, raw_col).mapInArrow(run, out).withColumnRenamed("key", key_col)


def valid_records(parsed: DataFrame) -> DataFrame:
    """The loaded rows of :func:`parse_records`."""
    return parsed.where("reason is null").drop("reason")


def rejected_records(parsed: DataFrame, key_col: str) -> DataFrame:
    """The rejected records of :func:`parse_records` with their reasons."""
    return parsed.where("reason is not null").select(key_col, "reason")
