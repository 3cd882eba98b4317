"""Near-duplicate groups and cross-split overlaps against brute force, with the edge cases."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from answerlab.llm import neardup, overlap


def runs(text):
    w = [x for x in re.split(r"[ \t\n\r]+", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def sim(a, b):
    a, b = runs(a), runs(b)
    return len(a & b) / len(a | b) if a and b else 0.0


def corpus(seed, n=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    boiler = [f"b{i}" for i in range(30)]
    out = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 7, 12, 30, 60, 150]))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 2)):
            edit = list(base)
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(edit))
                edit[i : i + rng.randint(0, 1)] = [rng.choice(words)]
            out.append(("\t" if rng.random() < 0.5 else "  ").join(edit).upper())
        if rng.random() < 0.5:
            out.append(" ".join(boiler + base[:20]))
    return [*out, None, "", "  \n\t ", "one", "ONE", "x " * 4000 + "end", "x " * 4000 + "end"]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(f"{i:04d}", t, 1, "k") for i, t in enumerate(corpus(3))]
    rows += rows[:5] + [(None, rows[0][1], 1, "k"), ("9999", rows[0][1], 1, "k")]
    return rows, spark.createDataFrame(rows, "complaint_id string, narrative string, key int, text string")


def test_pairs_equal_brute_force(table):
    rows, df = table
    got = {tuple(r) for r in neardup.near_duplicate_pairs(df, "complaint_id", "narrative", 0.6).collect()}
    one = sorted({(i, t) for i, t, *_ in rows if i})
    want = {(a, b) for k, (a, x) in enumerate(one) for b, y in one[k + 1 :] if a != b and sim(x, y) >= 0.6}
    assert got <= want
    assert len(got) >= 0.98 * len(want) > 10


def test_groups(table):
    rows, df = table
    got = {r["id"]: r for r in neardup.near_duplicate_groups(df, "complaint_id", "narrative", 0.6).collect()}
    assert set(got) == {i for i, t, *_ in rows if i and runs(t)}
    pairs = [tuple(r) for r in neardup.near_duplicate_pairs(df, "complaint_id", "narrative", 0.6).collect()]
    root = {i: i for i in got}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert {i: r["class_id"] for i, r in got.items()} == {i: find(i) for i in got}


def test_popular_groups_keep_their_pairs(spark):
    """A third of all rows are versions of one letter; nodes may hold four texts, hot ones are cut into blocks of five."""
    rng = random.Random(5)
    letter = [f"l{i}" for i in range(60)]
    rows = []
    for i in range(90):
        text = list(letter)
        if i % 3 == 0:
            text[rng.randrange(60)] = f"e{i}"
        else:
            text = [f"r{rng.randrange(9999)}" for _ in range(40)]
        rows.append((f"{i:03d}", " ".join(text)))
    df = spark.createDataFrame(rows, "complaint_id string, narrative string")
    want = sum(sim(a, b) >= 0.6 for k, (_, a) in enumerate(rows) for _, b in rows[k + 1 :])
    for more in ({"hot_share": 1.0}, {"hot_share": 0.01, "block": 5}):
        got = neardup.Forest(df, "complaint_id", "narrative", 0.6, node_limit=4, **more)
        assert {r["depth"] for r in got.prefix_lengths().collect()} & {4, 5} and len(got.rounds) > 1
        assert got.pairs.count() == want > 400


def test_recall_of_every_band_against_its_estimate(spark):
    """Families of versions at all similarities, in nodes beyond the limit: the estimate holds in every band."""
    rng = random.Random(31)
    boiler = [f"b{i}" for i in range(40)]
    rows, want = [], {}
    for f in range(60):
        base = [f"w{f}x{i}" for i in range(110)]
        group = []
        for v in range(7):
            edit = list(base)
            for k in rng.sample(range(110), rng.randint(0, 5)):
                edit[k] = f"e{f}x{v}x{k}"
            group.append((f"{f:02d}{v}", " ".join(edit + boiler)))
        rows += group
        want |= {(a, b): s for k, (a, x) in enumerate(group) for b, y in group[k + 1 :] if (s := sim(x, y)) >= 0.6}
    df = spark.createDataFrame(rows, "complaint_id string, narrative string")
    forest = neardup.Forest(df, "complaint_id", "narrative", 0.6, node_limit=12)
    assert forest.prefix_lengths().count() > 0
    key = {r["id"]: r["key"] for r in forest.members.collect()}
    got = {tuple(sorted(r[:2])) for r in forest.pairs.collect()}
    for lo in (0.6, 0.7, 0.8, 0.9):
        band = [p for p, s in want.items() if lo <= s < lo + 0.1]
        hit = sum(tuple(sorted((key[a], key[b]))) in got for a, b in band)
        assert len(band) > 30 and hit >= 0.985 * len(band), (lo, hit, len(band))


SCHEMA = "complaint_id string, narrative string"


def overlaps(spark, train, test):
    found = overlap.split_overlaps(spark.createDataFrame(train, SCHEMA), {"test": spark.createDataFrame(test, SCHEMA)}, "complaint_id", "narrative")
    return {(r["train_id"], r["eval_id"]) for r in found.collect()}


def test_overlaps_equal_brute_force(spark):
    texts = corpus(7)
    schema = "complaint_id string, narrative string, split string, e int, submitted_via string"
    via = ["Web", " web ", None, "Phone"]
    rows = [(f"{i:04d}", t, "z", 1, via[i % 4]) for i, t in enumerate(texts)]
    train, dev, test = rows[::2], rows[1::4] + rows[:2], rows[3::4] + rows[:1] * 3
    df = [spark.createDataFrame(r, schema) for r in (train, dev, test)]
    sides = {"dev": df[1], "test": df[2]}
    found = overlap.Overlaps(df[0], sides, "complaint_id", "narrative", 0.8)
    got = {(r["split"], r["train_id"], r["eval_id"]) for r in found.pairs().collect()}
    want = {(s, a, b) for s, side in (("dev", dev), ("test", test)) for a, x, *_ in train for b, y, *_ in side if sim(x, y) >= 0.8}
    assert got == want and len(want) > 5
    records = overlap.coverage_records(found, sides, "complaint_id", "submitted_via")
    per = {(r["split"], r["id"]): r for r in records.collect()}
    assert {k: r["records"] for k, r in per.items() if r["records"]} == {(s, e): sum((s, x, e) in want for x, *_ in train) for s, _, e in want}
    assert all(r["coverage"] is None or 0 <= r["coverage"] <= 1 for r in per.values())
    assert all(per[s, e]["coverage"] > 0.5 for s, _, e in want)
    report = {(r["split"], r["source"]): r for r in overlap.overlap_report(records).collect()}
    assert sum(r["pairs"] for r in report.values()) == len(want)
    assert report and all(s is None or s == s.strip().lower() for _, s in report)


def test_every_similarity_band_is_whole(spark):
    """Texts of all lengths with insertions, deletions, replacements, moved blocks and lost ends, right down to the threshold."""
    rng = random.Random(21)
    train, test = [], []
    for i in range(700):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([1, 4, 5, 8, 9, 14, 21, 22, 24, 30, 39, 40, 45, 49, 50, 54, 75, 76, 110, 112, 200, 400]))]
        if i % 9 == 0:
            base = base * rng.randint(2, 4)
        train.append((f"a{i:04d}", " ".join(base)))
        edit = list(base)
        for _ in range(rng.randint(0, max(1, len(base) // 34))):
            at, how = rng.randrange(len(edit)), rng.randrange(5)
            if how < 3:
                edit[at : at + (how > 0)] = ["new"] * (how < 2)
            elif how == 3:
                block, to = edit[at : at + 10], rng.randrange(len(edit))
                del edit[at : at + 10]
                edit[min(to, len(edit)) : min(to, len(edit))] = block
            else:
                edit = edit[rng.randint(0, 6) :] or edit
        edit = [f"p{rng.randrange(99)}" for _ in range(rng.choice([0, 0, 1, 5, 20]))] + edit
        test.append((f"b{i:04d}", " ".join(edit)))
    got = overlaps(spark, train, test)
    by: dict = {}
    for i, (a, x) in enumerate(train):
        for k in runs(x):
            by.setdefault(k, []).append((a, x))
    want = {}
    for b, y in test:
        for a, x in {p for k in runs(y) for p in by.get(k, ())}:
            if (v := sim(x, y)) >= 0.8:
                want[a, b] = v
    assert got == set(want)
    bands = [sum(lo <= v < lo + 0.05 for v in want.values()) for lo in (0.8, 0.85, 0.9, 0.95)]
    assert min(bands) > 20


def test_automaton_finds_passages_where_equal_cuts_would_not():
    """A training text holds an evaluation passage at another place and inside longer text; the scan finds it there."""
    import pyarrow as pa

    from answerlab.llm import textkernels as K

    tiling, flat = overlap.Tiling(0.8), np.zeros(overlap._COUNTERS, np.uint8)
    words = [f"w{i}" for i in range(120)]
    (e,) = K.shingle_texts([" ".join(words)])
    (t,) = K.shingle_texts([" ".join(["x", "y", "z", *words[5:70], "u", *words[70:], "v"])])
    found = lambda s: tiling.passages(s, overlap._codes(s.words), flat)
    text, lo, hi, anchor, kill, firm = found(e)
    assert firm.all() and len(lo) > kill[0] and set(anchor[:2]) & set(tiling.anchors(overlap._codes(t.words), t.first, np.array([120]), flat))
    cuts = lambda s: {tuple(s.words[a:b]) for a, b in zip(*found(s)[1:3])}
    assert not cuts(e) & cuts(t)  # equality of the two texts' passages would find nothing
    size = hi - lo
    codes = overlap._binary(overlap._codes(e.words)[K.ranges(lo, size)], size)
    passages = pa.table({"passage": K.span_hashes(e.words, lo, hi).view("int64"), "codes": codes})
    one = lambda x, kind: pa.array([x], pa.list_(kind))
    chunk = pa.table({"chunk": [7], "keys": one([1], pa.int64()), "sizes": one([9], pa.int32()), "lengths": one([len(t.words)], pa.int32()), "codes": [overlap._codes(t.words).tobytes()]})
    matched = overlap._scan(chunk, passages).num_rows
    assert len(lo) - kill[0] <= matched < len(lo)


def family(seed, edits, tail, n=50, words=300):
    """Training and evaluation versions of one letter, each with edits and an ending of its own."""
    rng = random.Random(seed)
    letter = [f"l{i}" for i in range(words)]
    out = []
    for i in range(2 * n):
        text = list(letter)
        for k in rng.sample(range(words), edits):
            text[k] = f"e{i}x{k}"
        out.append((f"{i:04d}", " ".join(text + [f"t{i}x{k}" for k in range(tail if i >= n else 0)])))
    return out[:n], out[n:]


def check_family(spark, train, test):
    want = {(a, b) for a, x in train for b, y in test if sim(x, y) >= 0.8}
    assert overlaps(spark, train, test) == want and len(want) > 1000


def test_boilerplate_joins_no_pairs(spark, monkeypatch):
    """A third of both sides holds one long notice that is more than half of each text: only real partners are compared."""
    monkeypatch.setattr(overlap, "_HOT", 20)
    rng = random.Random(9)
    notice = [f"n{i}" for i in range(100)]
    train, test = [], []
    for i in range(150):
        own = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        train.append((f"a{i:03d}", " ".join(own + notice)))
        edit = list(own)
        edit[30] = "changed"
        test.append((f"b{i:03d}", " ".join((edit if i % 10 == 0 else [f"v{rng.randrange(10**6)}" for _ in range(60)]) + notice)))
    compared = []
    verify = overlap.verify_pairs
    monkeypatch.setattr(overlap, "verify_pairs", lambda pairs, *a: compared.append(pairs.count()) or verify(pairs, *a))
    assert overlaps(spark, train, test) == {(a, b) for (a, x), (b, y) in zip(train, test) if sim(x, y) >= 0.8}
    assert compared[0] < 100


def test_passages_broken_by_own_edits_do_not_cost_partners(spark):
    check_family(spark, *family(11, edits=3, tail=0))


def test_texts_with_few_unshared_passages_keep_partners(spark, monkeypatch):
    """Also with rare runs in the place of popular passages, and small chunks."""
    monkeypatch.setattr(overlap, "_HOT", 8)
    monkeypatch.setattr(overlap, "CHUNK_TEXTS", 7)
    check_family(spark, *family(12, edits=2, tail=20))


def test_what_is_sent_grows_with_the_tables(spark):
    """Four times the rows, as copies under other ids: what is shuffled grows as much, although chunks and repeated passages both do."""
    rng = random.Random(17)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(60)]
    context = spark.sparkContext
    store, jvm = context._jsc.sc().statusStore(), context._jvm
    others = (False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())

    def stages():
        found = store.stageList(None, *others)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    sent = []
    for copies in (2, 8):
        rows = lambda side, c=copies: spark.createDataFrame(spark.sparkContext.parallelize([(f"{side}{k}-{i}", t) for k in range(c) for i, t in enumerate(texts)], c), SCHEMA)
        before = stages()
        assert overlap.split_overlaps(rows("a"), {"test": rows("b")}, "complaint_id", "narrative").count() == 60 * copies**2
        sent.append(sum(n for k, n in stages().items() if k not in before))
    assert sent[1] < 5 * sent[0], sent


def test_passages_with_equal_codes_are_both_found():
    import pyarrow as pa

    codes = np.arange(100, 120).astype(np.uint16)
    one = lambda x, kind: pa.array([x], pa.list_(kind))
    chunk = pa.table({"chunk": [7], "keys": one([1], pa.int64()), "sizes": one([9], pa.int32()), "lengths": one([20], pa.int32()), "codes": [codes.tobytes()]})
    passages = pa.table({"passage": [5, 6, 8], "codes": [codes[:16].tobytes(), codes[:16].tobytes(), codes[2:].tobytes()]})
    assert sorted(overlap._scan(chunk, passages).column("passage").to_pylist()) == [5, 6, 8]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "complaint_id string, narrative string")
    one = spark.createDataFrame([("1", "a b c d e f")], "complaint_id string, narrative string")
    assert neardup.near_duplicate_pairs(empty, "complaint_id", "narrative", 0.6).count() == 0
    assert neardup.near_duplicate_groups(empty, "complaint_id", "narrative", 0.6).count() == 0
    assert overlap.split_overlaps(empty, {"dev": one}, "complaint_id", "narrative").count() == 0
    assert overlap.split_overlaps(one, {"dev": empty}, "complaint_id", "narrative").count() == 0


def test_recall_estimate():
    assert neardup.recall_at(0.6, [neardup.FLOOR] * neardup.TREES) > 0.99
    assert neardup.recall_at(0.6, [5] * 20) < neardup.recall_at(0.6, [4] * 20)
