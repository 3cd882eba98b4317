"""From candidates to the guarded report: resumable answering, exports, calibration, subsets and the commands."""

from __future__ import annotations

import datetime
import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from answerlab import __main__ as commands
from answerlab.operators import answerers as A
from answerlab.operators import metrics, models, prepare
from answerlab.operators.answer_cache import AnswerCache, Backup
from answerlab.plans import guard, report

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PLUGIN = '''
import numpy as np
import zlib


class Tok:
    cls, sep, pad = 1, 2, 0

    def __call__(self, text):
        return [3 + zlib.crc32(w.encode()) % 997 for w in text.split()]


def forward(ids, mask):
    t = (ids * mask).sum(1)
    return np.stack([t % 11, t % 7, t % 5], 1).astype(float)


def local():
    return Tok(), forward, {"contradiction": 0, "entailment": 1, "neutral": 2}


def hosted(text, questions, model):
    from answerlab.operators.answerers import AnswererHttpError

    if "refuse" in text:
        raise AnswererHttpError(422)
    v = (zlib.crc32(text.encode()) % 100) / 100
    answers = {q["id"]: {"type": "noul", "noul": v} if q["type"] == "noul" else {"type": "score", "probabilities": {"0": 1 - v, "1": v}} for q in questions}
    return {"model": model, "answers": answers, "usage": {"input_tokens": 10}}
'''
QUESTIONS = """
status: draft
direct: {id: d, type: noul, question: is it direct, nli_hypothesis: yes}
questions:
- {id: q1, type: noul, question: is it, nli_hypothesis: it is so}
- {id: q2, type: score, question: how much, levels: [low, high], nli_hypotheses: [it is low, it is high]}
"""


def test_verdict_and_draw_at_their_bounds(spark):
    for lo, hi, want in ((-0.02, 0.02, "equivalent"), (-0.02, 0.021, "inconclusive"), (-0.0201, 0.0, "inconclusive"), (0.0, 0.02, "equivalent")):
        assert report.say(lo, hi) == want
        got = spark.createDataFrame([(lo, hi)], "lo double, hi double").select(metrics.verdict(F.col("lo"), F.col("hi"), 0.02)).first()[0]
        assert got == want
    assert [prepare.positives_wanted(*x) for x in ((1, 5, 5), (10, 50, 1), (10, 1, 50), (10, 0, 50), (10, 50, 0), (4, 2, 2), (0, 3, 3))] == [0, 9, 1, 0, 10, 2, 0]
    assert models.draw(np.array([1] * 50 + [0]), 10, 0).max() == 50  # the one negative is drawn
    df = spark.createDataFrame([(i, int(i > 0)) for i in range(51)], "id long, y int")
    assert sorted(r["y"] for r in prepare.stratified_draw(df, 10, 1, "id").collect())[:2] == [0, 1]
    assert report.first_not_beating({300: -1.0, 1000: -0.5}) == "never beats"
    assert report.first_not_beating({300: 1.0, 1000: 0.0}) == 1000 and report.first_not_beating({300: 1.0}) is None


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    """A frozen folder of 120, 40 and 40 rows, one of them refused by the hosted answerer."""
    root = tmp_path_factory.mktemp("study")
    (root / "study_plugin.py").write_text(PLUGIN)
    (root / "q.yaml").write_text(QUESTIONS)
    sys.path.insert(0, str(root))
    spark.sparkContext.addPyFile(str(root / "study_plugin.py"))
    fields = ("product", "sub_product", "issue", "sub_issue", "company", "state", "tags", "submitted_via")
    rows = []
    for split, n, year in (("train", 120, 2019), ("dev", 40, 2023), ("test", 40, 2024)):
        for i in range(n):
            day = datetime.date(year + (i % 4 if split == "train" else i % 3 if split == "test" else 0), 1 + i % 5, 3)
            text = f"{'relief' if i % 5 == 0 else 'other'} words about {split} complaint {i}. " + ("refuse" if (split, i) == ("train", 7) else "more")
            rows.append((f"{split}{i:03d}", day, text, int(i % 5 == 0), *(f"{f}{i % 3}" for f in fields), split))
    schema = "complaint_id string, date_received date, narrative string, y int, " + ", ".join(f"{f} string" for f in fields) + ", split string"
    table = spark.createDataFrame(rows, schema)
    for s in ("train", "dev", "test"):
        part = table.where(F.col("split") == s).drop("split")
        (part.drop("y") if s == "test" else part).write.parquet(str(root / "frozen" / f"{s}.parquet"))
    table.where("split = 'test'").select("complaint_id", "y").write.parquet(str(root / "frozen" / "test_labels.parquet"))
    rng = np.random.default_rng(0)
    vectors = [(r[0], [float(x) for x in rng.normal(size=4) + r[3]]) for r in rows]
    spark.createDataFrame(vectors, "complaint_id string, vector array<float>").write.parquet(str(root / "vectors"))
    return root


def test_entailment_run_resumes_group_by_group(spark, study):
    import study_plugin

    rows = commands.split_rows(spark, str(study / "frozen")).limit(30)
    questions = commands.load_questions(str(study / "q.yaml"))
    cache = AnswerCache.open(spark, str(study / "resume"))
    tokenizer, _, labels = study_plugin.local()
    calls = []

    class Stop(Exception):
        pass

    class Cut(Backup):
        def tick(self):
            calls.append(cache.read().count())
            if len(calls) == 2:
                raise Stop
            return False

    with pytest.raises(Stop):
        A.run_entailment(rows, cache, questions, tokenizer, study_plugin.forward, labels, "m", group=8, backup=Cut(cache, str(study / "copy"), 1e9))
    done = cache.read().count()
    assert 0 < calls[0] < calls[1] == done < 30
    assert AnswerCache.open(spark, str(study / "other"), str(study / "copy")).read().count() == done  # flushed on the way out
    assert A.run_entailment(rows, cache, questions, tokenizer, study_plugin.forward, labels, "m") == 30 - done
    assert A.run_entailment(rows, cache, questions, tokenizer, study_plugin.forward, labels, "m") == 0
    row = cache.read().first()
    payload = json.loads(row["payload"])
    assert set(payload) == {"model", "max_chunks", "answers", "seconds"} and payload["answers"]["q1"]["type"] == "noul" and len(payload["answers"]["q2"]["level_logits"]) == 2
    direct = A.entailment_answers(rows, questions, tokenizer, study_plugin.forward, labels, "complaint_id", "narrative")
    want = {r["complaint_id"]: r for r in A.export_entailment(rows, direct, questions).collect()}
    got = A.export_entailment_cache(rows, cache.read(), questions).collect()
    assert len(got) == 30 and all(r["ok"] and r["q1"] == pytest.approx(want[r["complaint_id"]]["q1"]) and r["q2@1"] == pytest.approx(want[r["complaint_id"]]["q2@1"]) for r in got)


def test_run_stops_in_the_group_with_too_many_refusals(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), f"refuse {i}") for i in range(200)], "complaint_id string, narrative string")

    def call(text, questions, model):
        raise A.AnswererHttpError(422)

    from answerlab.operators.questions import Question, QuestionSet

    cache = AnswerCache.open(spark, str(tmp_path / "c"))
    with pytest.raises(A.TooManyFailures):
        A.run_hosted(rows, cache, QuestionSet((Question("q", "noul", "t", ("h",)),)), call, "m", group=40)
    assert 10 < cache.read().count() < 100


def test_token_vectors_are_averaged_under_their_mask():
    hidden = np.arange(24.0).reshape(2, 3, 4)
    mask = np.array([[1, 1, 0], [0, 0, 0]])
    got = A.pooled(lambda ids, m: hidden)(np.zeros((2, 3)), mask)
    assert got[0].tolist() == hidden[0, :2].mean(0).tolist() and got[1].tolist() == [0.0] * 4


def test_hashed_runs_count_as_spelled_ones(spark):
    from answerlab.functions import scalar

    texts = ["", None, "a", "a b c d e", "a b c d e f a b c d e f", "x " * 50, "A  b\tc"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(F.size(scalar.shingles(F.col("t"))).alias("a"), F.size(scalar.shingle_hashes(F.col("t"))).alias("b")).collect():
        assert r["a"] == r["b"]


def test_hand_labels_are_not_overwritten(spark, study):
    path = commands.main(["handlabels", "--frozen", str(study / "frozen"), "--questions", str(study / "q.yaml")], spark)
    lines = open(path).read().splitlines()
    assert lines[0] == "complaint_id,question_id,question,narrative,label" and len(lines) == 41 and lines[1].endswith(",")
    with pytest.raises(FileExistsError):
        commands.main(["handlabels", "--frozen", str(study / "frozen"), "--questions", str(study / "q.yaml")], spark)


def test_commands_answer_export_and_report(spark, study, monkeypatch):
    frozen, q, cache = str(study / "frozen"), str(study / "q.yaml"), str(study / "answers")
    base = ["--frozen", frozen, "--questions", q, "--cache", cache]
    run = lambda who, name, *more: commands.main(["run", who, *base, "--model", "m", "--plugin", f"study_plugin:{name}", *more], spark)
    assert run("hosted", "hosted", "--limit", "5")["answered"] == 5
    assert run("hosted", "hosted") == {"answered": 194, "refused": 1}
    assert run("local", "local") == 200 and run("local", "local") == 0
    assert commands.main(["export", *base], spark) == {"hosted": 0, "local": 0}
    dev = commands.main(["check-dev", "--frozen", frozen, "--questions", q], spark)
    assert {(r["answerer"], r["question"]) for r in dev} == {(a, x) for a in ("hosted", "local") for x in ("q1", "q2")} and all(r["n"] == 40 for r in dev)
    margin = report.calibrate_margin(*(spark.read.parquet(f"{frozen}/{s}.parquet") for s in ("train", "dev")), n_labels=30, boots=20)
    assert margin["pseudo_test_rows"] == 30 and margin["labels"] == 30 and margin["half_width"] >= 0
    from answerlab.plans import build

    questions = commands.load_questions(q)
    vectors = spark.read.parquet(str(study / "vectors"))
    closed = lambda args, cwd: (1, "")
    with pytest.raises(guard.GuardError):
        build.run_study(spark, frozen, str(study / "out"), questions, vectors, "plan", run=closed)
    assert not (study / "out" / "scoring_log.csv").exists()
    opened = lambda args, cwd: (0, "abc")
    (study / "frozen" / "handlabels.csv").write_text("complaint_id,question_id,question,narrative,label\ntest000,q1,t,n,1\ntest001,q1,t,n,0\n")
    monkeypatch.setattr(models, "BOOST_GRID", models.BOOST_GRID[:1])
    got = build.run_study(spark, frozen, str(study / "out"), questions, vectors, "plan", run=opened, label_counts=(40,), boots=20)
    head = json.loads((study / "out" / "headline.json").read_text())
    assert head["rows_used"] == {"train": 119, "dev": 40, "test": 40} and head["failures"]["hosted"]["train"] == 1
    assert head["compute"]["mean_input_tokens"] == 10 and head["answer_quality"]["hosted"]["status"] == "ok"
    assert {r["arm_id"] for r in got["rows"]} == set(range(10)) and head["hosted_vs_local"]["verdict"] and head["single_window"]["rows"] == 40
    assert set(head["direct_by_half_year"]) == {"2024H1", "2025H1", "2026H1"} and head["hosted_vs_local_2026"]["rows"] == 13
    assert head["variant"]["chosen"] in ("raw", "stacked") and (study / "out" / "scoring_log.csv").exists()
    probe = A.probe_longest(spark.read.parquet(f"{frozen}/train.parquet"), 3, commands.named("study_plugin:hosted"), "m")
    assert len(probe) == 3 and {p["status"] for p in probe} <= {"ok", "422"} and "answers" not in probe[0]


def test_subset_with_one_class_has_no_value(spark):
    rows = [(a, 10, 0, f"{i}", int(i % 2 == 0 and i < 20), float((i * (a + 3)) % 7)) for a in (8, 9) for i in range(40)]
    scores = spark.createDataFrame(rows, "arm_id int, n_labels int, seed int, complaint_id string, y int, score double")
    by = F.when(F.col("complaint_id").cast("int") < 20, "both").when(F.col("complaint_id").cast("int") < 39, "one")
    got = {r["subset"]: r for r in report.subset_intervals(scores, by, (9, 8), 30).collect()}
    assert got["one"]["status"] == "too few rows" and got["one"]["value"] is None
    assert got["both"]["rows"] == 20 and got["both"]["lo"] <= got["both"]["value"] <= got["both"]["hi"]


def test_filter_rates_and_split_commands(spark, tmp_path):
    import csv

    from answerlab.config import RAW_COLUMNS

    with open(tmp_path / "a.csv", "w", newline="") as f:
        out = csv.DictWriter(f, RAW_COLUMNS)
        out.writeheader()
        for i, day in enumerate(["2020-01-01", "2021-01-01", "2023-01-01", "2024-01-01", "2025-01-01"]):
            out.writerow({c: "" for c in RAW_COLUMNS} | {"Date received": day, "Product": "P", "Company response to consumer": "yes" if i % 2 else "no", "Complaint ID": str(i), "Consumer complaint narrative": f"text {i} " * 5})
    to = str(tmp_path / "c.parquet")
    assert commands.main(["filter", "--csv", str(tmp_path / "a.csv"), "--out", to, "--product", "P", "--response", "yes", "--response", "no", "--positive", "yes"], spark) == 5
    assert commands.main(["rates", "--candidates", to], spark)[0]["n"] == 2
    assert set(commands.main(["split", "--candidates", to, "--out", str(tmp_path / "frozen"), "--no-sample"], spark)) == {"train", "dev", "test"}
