from __future__ import annotations

import csv
import hashlib

import pytest

from answerlab.config import RAW_COLUMNS, REQUIRED_COLUMNS
from answerlab.operators import prepare as P
from answerlab.sources import tables as S

PRODUCTS = ("Checking or savings account", "Credit card")
ANSWERS = ("Closed with monetary relief", "Closed with explanation")
BASE = {"Date received": "2020-05-01", "Product": PRODUCTS[0], "Company": "Bank A", "Submitted via": "Web", "Company response to consumer": ANSWERS[1]}


def write(path, rows, columns=RAW_COLUMNS):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, columns, extrasaction="ignore")
        out.writeheader()
        for r in rows:
            out.writerow({c: "" for c in columns} | BASE | r)


ROWS = [
    {"Complaint ID": "1", "Consumer complaint narrative": "one two, three\nfour five six seven", "Company response to consumer": ANSWERS[0]},
    {"Complaint ID": "2", "Consumer complaint narrative": "he said \"no\" to me", "Date received": "03/04/2021", "Product": PRODUCTS[1]},
    {"Complaint ID": "3", "Consumer complaint narrative": "a dev text here", "Date received": "2023-02-01"},
    {"Complaint ID": "4", "Consumer complaint narrative": "quite another text of the test range", "Date received": "06/01/24"},
    {"Complaint ID": "5", "Consumer complaint narrative": "open", "Company response to consumer": "In progress"},
    {"Complaint ID": "6", "Consumer complaint narrative": "late", "Date received": "2026-06-16"},
    {"Complaint ID": "7", "Consumer complaint narrative": "report", "Product": "Credit reporting"},
    {"Complaint ID": "8", "Consumer complaint narrative": "   "},
    {"Complaint ID": "9", "Consumer complaint narrative": ""},
    {"Complaint ID": "10", "Consumer complaint narrative": "one two, three\nfour five six seven", "Date received": "2025-01-01"},
]


@pytest.fixture
def candidates(spark, tmp_path):
    write(tmp_path / "a.csv", ROWS[:5])
    write(tmp_path / "b.csv", ROWS[5:])
    return P.filter_candidates(S.read_export(spark, str(tmp_path / "*.csv")), PRODUCTS, ANSWERS, ANSWERS[0])


def test_filter(candidates):
    got = {r["complaint_id"]: r for r in candidates.collect()}
    assert set(got) == {"1", "2", "3", "4", "10"}
    assert got["1"]["y"] == 1 and got["2"]["y"] == 0
    assert got["1"]["narrative"] == ROWS[0]["Consumer complaint narrative"] and got["2"]["narrative"] == 'he said "no" to me'
    assert str(got["4"]["date_received"]) == "2024-06-01"
    assert got["1"]["sub_issue"] is None


def test_strict_dates_read_no_two_digit_years(spark, tmp_path):
    write(tmp_path / "a.csv", ROWS)
    raw = S.read_export(spark, str(tmp_path / "a.csv"))
    assert "4" not in {r["complaint_id"] for r in P.filter_candidates(raw, PRODUCTS, ANSWERS, ANSWERS[0], strict_dates=True).collect()}


def test_headers_are_checked(spark, tmp_path):
    write(tmp_path / "a.csv", ROWS[:1])
    write(tmp_path / "b.csv", ROWS[1:2], (*RAW_COLUMNS[:-1], "Id"))
    with pytest.raises(ValueError, match="header differs"):
        S.read_export(spark, str(tmp_path / "*.csv"))
    write(tmp_path / "c.csv", ROWS[:1], tuple(c for c in RAW_COLUMNS if c != REQUIRED_COLUMNS[1]))
    with pytest.raises(ValueError, match="missing columns"):
        S.read_export(spark, str(tmp_path / "c.csv"))


def test_rates_use_training_dates_only(candidates):
    got = {r["product"]: (r["n"], r["rate"], r["in_band"]) for r in P.group_rates(candidates).collect()}
    assert got == {PRODUCTS[0]: (1, 1.0, False), PRODUCTS[1]: (1, 0.0, False)}


def test_split_drops_near_duplicates_and_keeps_labels_apart(spark, candidates, tmp_path):
    splits = P.split_by_time(candidates, {"train": 10, "dev": 10, "test": 10})
    ids = {k: {r["complaint_id"] for r in df.collect()} for k, df in splits.items()}
    assert ids == {"train": {"1", "2"}, "dev": {"3"}, "test": {"4"}}
    hashes = P.write_splits(splits, str(tmp_path))
    assert hashes["train"] == hashlib.sha256(b"1\n2\n").hexdigest()
    assert "y" not in spark.read.parquet(str(tmp_path / "test.parquet")).columns
    assert spark.read.parquet(str(tmp_path / "test_labels.parquet")).columns == ["complaint_id", "y"]


def test_repeated_id_is_refused(spark, candidates):
    twice = candidates.where("complaint_id = '1'").unionByName(candidates.where("complaint_id = '1'"))
    with pytest.raises(ValueError, match="twice"):
        P.split_by_time(twice, {"train": 10, "dev": 10, "test": 10})


def test_near_pairs_equal_brute_force(spark):
    import random

    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    boiler = " ".join(f"b{i}" for i in range(25))
    texts = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(1, 60))]
        texts += [" ".join(base), " ".join(base[:-1] + ["zz"]), boiler + " " + " ".join(base[:12])]
    texts += ["", "  ", "one", "One"]
    rows = list(enumerate(texts))
    left, right = rows[::2], rows[1::2] + rows[:6]
    df = [spark.createDataFrame(r + [(999, None)], "id long, text string") for r in (left, right)]
    got = {(r["left_key"], r["right_key"]) for r in P.near_pairs(*df).collect()}
    key = {r["text"]: r["k"] for r in spark.createDataFrame(rows, "id long, text string").selectExpr("text", "xxhash64(text) AS k").collect()}

    def sh(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    want = {(key[a], key[b]) for _, a in left for _, b in right if sh(a) and sh(b) and len(sh(a) & sh(b)) / len(sh(a) | sh(b)) >= 0.8}
    assert got == want and want


def test_draws(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(100)], "id long, y int")
    got = P.stratified_draw(df, 30, 1, "id").collect()
    assert len(got) == 30 and sum(r["y"] for r in got) == 3
    assert {r["id"] for r in got} == {r["id"] for r in P.stratified_draw(df, 30, 1, "id").collect()}
    with pytest.raises(ValueError):
        P.stratified_draw(df, 101, 1, "id")
    per = P.folds(df, 5, "id").groupBy("fold").sum("y").collect()
    assert sorted(r[1] for r in per) == [2] * 5
    empty = P.id_hash(df.where("id < 0"), "id").first()
    assert empty["sha256"] == hashlib.sha256(b"").hexdigest()
