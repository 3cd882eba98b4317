"""Splitting, personal information, packing, mixing and reading level, with the edge cases."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from answerlab.llm import mixing, packing, pii, queries, reading, splitting, tokens


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb.", "c!)", "\n", "\n\n", "\t", "dd", "e"]), max_size=120), st.integers(4, 20), st.integers(0, 3))
def test_pieces_give_back_the_text(parts, limit, overlap):
    text = " ".join(parts)
    pieces = splitting.split_text(text, limit, overlap)
    n = len(re.findall(r"[^ \t\n\r]+", text))
    if not n:
        assert pieces == []
        return
    assert "".join(p[9][p[7] :] for p in pieces) == text
    _, strength = splitting.boundaries(text)
    done = 0
    for i, (no, total, cut, first, last, size, lap, _, ends, _) in enumerate(pieces):
        assert no == i + 1 and total == len(pieces) and size <= limit and size == last - first + 1
        assert lap == (min(overlap, done) if i else 0) and first == done - lap + 1 and last > done
        reach = done + (limit - overlap if i else limit)
        if ends == "forced":
            assert not strength[done:reach].any()
        done = last
    assert done == n
    assert (pieces[0][2] == "forced") == (splitting.longest_run(strength) > limit)


def test_split_table_edges(spark):
    long = "word. " * 600
    rows = [("1", long, 1), ("1", long, 1), (None, long, 1), ("2", "short", 1), ("3", None, 1), ("4", "  ", 1), ("5", "x " * 600, 1)]
    df = spark.createDataFrame(rows, "complaint_id string, narrative string, piece int")
    got = splitting.split_oversized(df, "complaint_id", "narrative").collect()
    assert {r["id"] for r in got} == {"1", None, "5"} and len(got) == 8
    assert {(r["id"], r["cut"]) for r in got} == {("1", "natural"), (None, "natural"), ("5", "forced")}
    assert splitting.split_oversized(df.where("piece = 0"), "complaint_id", "narrative").count() == 0
    with pytest.raises(ValueError):
        splitting.split_oversized(df, "complaint_id", "narrative", 10, 10)


LEXICON = [("Marta", "given"), ("odile ", "given"), ("GROVIX", "family"), ("Thaliast", "family"), ("Grace", "given"), ("bank", "not_name"), (None, "given"), ("Bo", None)]
TEXTS = {
    "My name is Marta R. Grovix and I have been a member for two days.": {("person_name", "martargrovix")},
    "the agent, thaliast, odile, said that it was over.": {("person_name", "thaliastodile")},
    "I spoke with Grace about it.": set(),
    "Write to me at marta dot grovix at postbox dot example about it.": {("email", "martadotgrovixatpostboxdotexample")},
    "I answered <m.grovix+bank@mail.example> at once; the handle @member_care12 is dead.": {("email", "mgrovixbankmailexample")},
    "The masked form shows XXX-XXX-XXXX and XXXX@XXXX for the contact.": set(),
    "My number is (412) 555-0161. I dialed +44 20 7946 0457 ext. 59 and waited.": {("phone", "4125550161"), ("phone", "442079460457")},
    "Call me back on four one two, five five five, zero one six one after noon.": {("phone", "fouronetwofivefivefivezeroonesixone")},
    "My SSN is 949 - 15 - 6570, please; passport number: C17033060.": {("id_number", "949156570"), ("id_number", "c17033060")},
    "Only the last four, 4147, of my social; parcel number 7862 5967 7006 6361; invoice 20-2298-883.": set(),
    "My old address, 169-171 NE 4th Drive, was on file; the branch near Babiask Avenue was shut.": {("street_address", "169171ne4thdrive")},
    "Please mail the check to Forty Prialiall Park Row in East Kaekirt. Mail for P.O. Box 12.": {("street_address", "fortyprialiallparkrow")},
    "The ledger lists 12 checks at Drouzeall Plaza, which means nothing.": set(),
}


@pytest.fixture(scope="module")
def people(spark):
    rows = [(str(i), t, 0, "c") for i, t in enumerate(TEXTS)]
    more = [(f"m{i}", t, 0, "c") for i in range(40) for t in list(TEXTS)[:2] + list(TEXTS)[6:9]]
    edge = [("n", None, 0, "c"), ("e", "", 0, "c"), ("b", " \n", 0, "c"), ("0", next(iter(TEXTS)), 0, "c")]
    df = spark.createDataFrame(rows + more + edge, "complaint_id string, narrative string, start int, kind string")
    return df, spark.createDataFrame(LEXICON, "name string, kind string")


def test_items_found(people):
    df, lexicon = people
    got: dict[str, set] = {}
    for r in pii.personal_information(df, "complaint_id", "narrative", lexicon).collect():
        got.setdefault(r["id"], set()).add((r["kind"], r["value"]))
    for i, (text, want) in enumerate(TEXTS.items()):
        assert got.get(str(i), set()) == want, text
    assert not {"n", "e", "b"} & set(got)


#: Another style than the test tables': letters, notes and forms written for this test.
HELD_OUT = [
    ("Dear Ms. Alvarez, my landlord Peter Novak paid the fee on Monday.", {("person_name", "peternovak")}),
    ("I then met Hannah Weiss in the lobby, and Dr. Omar Haddad joined us.", {("person_name", "hannahweiss"), ("person_name", "omarhaddad")}),
    ("Patient: Maria de la Cruz; tel. 415-555-2671; SSN 523-45-6789.", {("person_name", "mariadelacruz"), ("phone", "4155552671"), ("id_number", "523456789")}),
    ("Kindly reply to j.smith-jones@uni.example.edu or ring (212) 555-7788 ext. 4.", {("email", "jsmithjonesuniexampleedu"), ("phone", "2125557788")}),
    ("We moved to 48 Linden Street last spring; the old house at 7B Harbour Road is sold.", {("street_address", "48lindenstreet"), ("street_address", "7bharbourroad")}),
    ("Respectfully,\nGeorge T. Hamilton", {("person_name", "georgethamilton")}),
    ("Invoice 20394857 of 12/05/2021 lists 14 boxes at 30 dollars each.", set()),
    ("Our order 5567-8890-1123-4456 shipped from Springfield in 3 weeks.", set()),
    ("Write to ana at mailhost dot org if the call to +49 30 901820 fails.", {("email", "anaatmailhostdotorg"), ("phone", "4930901820")}),
    ("My passport number is K40918273 and my driver's license D1234567.", {("id_number", "k40918273"), ("id_number", "d1234567")}),
    ("The clerk, Novak, Peter, asked about 1200 Rue Lafayette.", {("person_name", "novakpeter"), ("street_address", "1200ruelafayette")}),
    ("Grace and hope were all that Union Savings Bank left us on Friday.", set()),
    ("I spoke with Priya Raman about the mortgage, then with a supervisor named Tom Becker.", {("person_name", "priyaraman"), ("person_name", "tombecker")}),
    ("He asked for my taxpayer ID, 912-70-1234, and for the last four digits, 4411.", {("id_number", "912701234")}),
    ("Call Jonas Lindqvist at 650 555 0147; he lives at 2203 West Maple Avenue, Apt 5.", {("person_name", "jonaslindqvist"), ("phone", "6505550147"), ("street_address", "2203westmapleavenue")}),
]
OTHER_NAMES = [(n, "given") for n in ("Peter", "Hannah", "Omar", "Maria", "George", "Priya", "Tom", "Grace")] + [(n, "family") for n in ("Novak", "Weiss", "Haddad", "Hamilton", "Becker")]


def held_out(spark, lexicon):
    """(found, right) of the held-out texts, found beside the test tables' candidates, which the model learns from."""
    rows = spark.createDataFrame([(f"h{i}", t) for i, (t, _) in enumerate(HELD_OUT)], "complaint_id string, narrative string")
    known = queries.table(spark, "/root/testdata/sf0.01", "candidates").select("complaint_id", "narrative")
    got = pii.personal_information(known.unionByName(rows), "complaint_id", "narrative", lexicon).where("id like 'h%'").collect()
    return {(r["id"], r["kind"], r["value"]) for r in got}, {(f"h{i}", k, v) for i, (_, want) in enumerate(HELD_OUT) for k, v in want}


def test_another_style_is_found(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    lexicon = queries.table(spark, "/root/testdata/sf0.01", "name_lexicon").select("name", "kind")
    found, right = held_out(spark, lexicon.unionByName(spark.createDataFrame(OTHER_NAMES, "name string, kind string")))
    print("precision", len(found & right) / len(found), "recall", len(found & right) / len(right), sorted(right - found), sorted(found - right))
    assert len(found & right) >= 0.85 * len(right) and len(found & right) >= 0.9 * len(found)
    bare, _ = held_out(spark, lexicon.where("name is null"))
    assert len(bare & right) < len(found & right)


def test_model_differs_from_majority(spark):
    """On the test tables the labelers disagree, and what is taken is not what most of them say."""
    import os

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    spans = pii.candidate_spans(queries.table(spark, d, "candidates"), "complaint_id", "narrative", queries.table(spark, d, "name_lexicon"))
    counts = [(r["kind"], r["votes"], r["n"]) for r in spans.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()]
    model = pii.accepted_patterns(counts)
    most = lambda v: v.split("|")[0].count("+") > v.split("|")[0].count("-")
    differ = {k: sum(n for kind, v, n in counts if kind == k and most(v) != (model[k][v] >= 0.5)) for k in pii.KINDS}
    mixed = {k: sum(n for kind, v, n in counts if kind == k and "+" in v and "-" in v) for k in pii.KINDS}
    assert differ["street_address"] > 50 and min(mixed[k] for k in ("phone", "id_number", "street_address", "person_name")) > 50


def test_redaction_changes_nothing_else(people):
    df, lexicon = people
    got = {r["id"]: r for r in pii.redacted(df, "complaint_id", "narrative", lexicon).collect()}
    assert got["n"]["redacted"] is None and got["e"]["redacted"] == ""
    assert got["0"]["redacted"] == "My name is [PERSON_NAME] and I have been a member for two days." and got["0"]["items"] == 1
    assert got["2"]["redacted"] == list(TEXTS)[2]
    empty = df.where("complaint_id = 'none'")
    assert pii.redacted(empty, "complaint_id", "narrative", lexicon).count() == 0
    assert pii.personal_information(empty, "complaint_id", "narrative", lexicon).count() == 0


def test_offsets_survive_letters_that_grow():
    gaz = pii.Gazetteer([("Marta", "given")])
    text = "İİ my number is 412-555-0161."
    (a, b, kind, _), = pii.find_spans(text, gaz)
    assert (text[a:b], kind) == ("412-555-0161", "phone")


def test_hilbert_key_is_a_curve():
    side = 8
    grid = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    key = packing.hilbert_key(grid, 3)
    assert sorted(key.tolist()) == list(range(side**3))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_packing_places_everything_once(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["bank", "fee", "card", "letter"]) for _ in range(rng.choice([0, 1, 30, 200, 700, 1500]))), 1) for i in range(200)]
    rows += [(900, None, 1), (901, "", 1), (None, "no id", 1)] + rows[:2] + [(1000 + i, "copy of one text", 1) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size int")
    boxes = packing.pack_documents(df, "doc_id", "text", 512).collect()
    seen: dict = {}
    for b in boxes:
        used = sum(x["token_to"] - x["token_from"] for x in b["items"])
        assert used == b["used"] <= 512 and b["n_items"] == len(b["items"])
        for x in b["items"]:
            seen.setdefault(x["doc_id"], []).append((x["token_from"], x["token_to"]))
    assert len({b["container_id"] for b in boxes}) == len(boxes)
    texts = {i: t for i, t, _ in rows}
    assert set(seen) == {i for i, t in texts.items() if t is not None}
    for i, parts in seen.items():
        size = tokens.count_tokens(texts[i])
        if i not in (0, 1):
            parts = sorted(parts)
            assert parts[0][0] == 0 and parts[-1][1] == size and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
            assert len(parts) == max(1, -(-size // 512))
    assert packing.fill_report(packing.pack_documents(df, "doc_id", "text", 512)).first()["mean_fill"] > 0.9
    assert packing.pack_documents(df.where("size = 0"), "doc_id", "text").count() == 0


def off_by(want, block):
    """The largest deviation of any source's blocks from its exact share of the slots, over all slots, as a fraction."""
    slots, total = mixing.schedule(want, block), sum(want.values())
    done, worst = dict.fromkeys(want, 0), 0
    for t, s in enumerate(slots, 1):
        if t <= total // block:
            behind = max(abs(done[k] * total - (t - 1) * want[k]) for k in want) if t < 3000 else abs(done[s] * total - (t - 1) * want[s])
            done[s] += 1
            worst = max(worst, behind, abs(done[s] * total - t * want[s]))
        else:
            done[s] += 1
    assert done == {s: -(-n // block) for s, n in want.items()}
    return worst / total


def test_schedule_stays_within_a_block():
    rng = random.Random(3)
    for _ in range(60):
        want = {f"s{i}": rng.randint(1, 10 ** rng.randint(1, 6)) for i in range(rng.randint(1, 12))}
        assert off_by(want, rng.choice([1, 7, 100]) if sum(want.values()) < 50_000 else 1_000) < 1


def test_schedule_of_a_hundred_million_blocks_does_not_drift():
    """8e11 tokens are 1e8 blocks of the usual size; the mixture makes them larger and stays exact to the token."""
    want = {"a": 74_348_238_871, "b": 500_000_000_003, "c": 225_651_761_126, "d": 1_234_567}
    size = mixing.block_size(want)
    assert sum(want.values()) / mixing.BLOCK_TOKENS > 0.97e8 and sum(want.values()) / size <= mixing.MAX_BLOCKS
    assert off_by(want, size) < 1


def test_mixture(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["word"] * rng.randint(5, 60)), rng.choice(["Big", " big", "BIG", "small-one", None, "other"]), 1) for i in range(600)]
    rows += rows[:3] + [(7000, None, "big", 1), (7001, "", "big", 1), (None, "x y", "big", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, slot int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small_one", 0.45, 3), ("absent", 0.05, 4)], "source string, target_share double, max_repeats int")
    mix = mixing.mixed(df, "doc_id", "text", "source", targets, block_tokens=64)
    got = mix.collect()
    assert {r["source"] for r in got} == {"big", "small_one"}
    uses: dict = {}
    for r in got:
        uses.setdefault((r["source"], r["doc_id"]), []).append(r["use_no"])
    assert all(sorted(u) == list(range(1, len(u) + 1)) and len(u) <= (1 if s == "big" else 3) for (s, _), u in uses.items())
    share = {r["source"]: r for r in mixing.share_report(mix, targets).collect()}
    assert all(r["largest_deviation"] < 1.01 for r in mixing.deviations(mix, 64).collect())
    assert share["absent"]["tokens"] == 0 and not share["absent"]["met"]
    assert abs(share["big"]["actual_share"] / share["small_one"]["actual_share"] - 0.5 / 0.45) < 0.05
    assert mixing.mixed(df.where("slot = 0"), "doc_id", "text", "source", targets).count() == 0


def test_ordinal_model_recovers_levels():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = np.digitize(2 * x[:, 0] - x[:, 1] + 0.2 * rng.normal(size=600), [-2, 0, 2]) + 1
    model = reading.fit_ordinal(x[:400], y[:400])
    assert (model.level(x[400:]) == y[400:]).mean() > 0.85
    assert np.corrcoef(model.score(x[400:]), y[400:])[0, 1] > 0.9


def test_reading_levels_held_out(spark):
    """Graded texts of the test data: what half of them teach, the other half confirms."""
    import os

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    docs, labels = queries.table(spark, d, "documents"), queries.table(spark, d, "reading_labels")
    half = labels.where("pmod(xxhash64(doc_id), 2) = 0")  # held-out accuracy, not a query
    rest = reading.graded(labels.where("pmod(xxhash64(doc_id), 2) = 1"), "doc_id", "level")
    got = reading.reading_levels(docs, "doc_id", "text", half, "doc_id", "level").join(rest.withColumnRenamed("level", "truth"), "id").distinct().collect()
    assert sum(abs(r["level"] - r["truth"]) <= 1 for r in got) >= 0.9 * len(got) > 10


def test_reading_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (4, "the fee is low and the man said so.", "x"), (4, "the fee is low and the man said so.", "x")], "doc_id long, text string, level string")
    none = spark.createDataFrame([(4, None, "r1")], "doc_id long, level int, rater string")
    got = reading.reading_levels(docs, "doc_id", "text", none, "doc_id", "level").collect()
    assert len(got) == 5 and all(r["level"] is None for r in got)
    one = spark.createDataFrame([(4, 2, "r1"), (4, 2, "r1"), (4, 3, "r2"), (99, 1, "r1")], "doc_id long, level int, rater string")
    got = {r["id"]: r["level"] for r in reading.reading_levels(docs, "doc_id", "text", one, "doc_id", "level").collect()}
    assert got == {1: None, 2: None, 3: None, 4: 2}
