from __future__ import annotations

import datetime
import json
import math
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from answerlab.functions import scalar
from answerlab.operators import answerers as A
from answerlab.config import BOOTSTRAPS, LABEL_COUNTS, SPLIT_ROWS
from answerlab.operators import features, metrics, models, prepare
from answerlab.operators.answer_cache import AnswerCache, Backup
from answerlab.operators.questions import Question, QuestionSet, load_questions
from answerlab.plans import guard, registry
from answerlab.plans.report import interval, run_report, say


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the executors can't import a test module


def ap(y, s):
    return models.average_precision(np.array(y), np.array(s, float))


def test_curves(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.9), ("a", 1, 0.4), ("a", 0, 0.1), ("b", 1, 0.2), ("b", 1, 0.3), ("c", None, 0.3), ("a", 1, None)]
    df = spark.createDataFrame(rows, "g string, y int, score double")
    got = {r["g"]: r["pr_auc"] for r in metrics.average_precision(df, ["g"]).collect()}
    assert got["a"] == pytest.approx(ap([1, 0, 1, 0], [0.9, 0.9, 0.4, 0.1])) == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    assert math.isnan(got["b"]) and "c" not in got
    roc = {r["g"]: r["roc_auc"] for r in metrics.roc_auc(df, ["g"]).collect()}
    assert roc["a"] == pytest.approx((0.5 + 1 + 0 + 1) / 4)
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 500), rng.integers(0, 40, 500) / 7
    many = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, score double")
    assert metrics.average_precision(many, []).first()[0] == pytest.approx(ap(y, s))


def test_intervals_and_verdicts(spark):
    df = spark.createDataFrame([(float(x),) for x in range(101)] + [(float("nan"),)], "x double")
    r = metrics.ci95(df, [], "x").first()
    assert (r["mean"], r["lo"], r["hi"]) == (50.0, 2.5, 97.5)
    assert interval(np.arange(101.0)) == (2.5, 97.5)
    ends = [(0.005, 0.015, "first better"), (-0.015, -0.005, "second better"), (-0.01, 0.01, "equivalent"), (-0.03, 0.01, "inconclusive")]
    cols = spark.createDataFrame(ends, "lo double, hi double, want string")
    for r in cols.select("*", metrics.verdict(F.col("lo"), F.col("hi"), 0.02).alias("got")).collect():
        assert r["got"] == r["want"] == say(r["lo"], r["hi"])
    for lows, want in (([(1, -1.0), (2, -2.0)], ("never beats", None)), ([(1, 1.0), (2, 2.0)], ("keeps beating", None)), ([(1, -1.0), (2, 1.0), (3, 0.0)], ("stops", 3))):
        got = metrics.stops_beating(spark.createDataFrame(lows, "n_labels int, lo double")).first()
        assert tuple(got) == want


def test_levels_and_chunks(spark):
    one = spark.range(1)
    m = F.create_map(*(F.lit(x) for x in ("0", 0.2, "1", 0.5, "2", 0.3)))
    assert one.select(scalar.expected_level(m)).first()[0] == pytest.approx(1.1)
    assert one.select(scalar.level_from_logits(F.array(*[F.lit(0.0)] * 3))).first()[0] == pytest.approx(1.0)
    for n in (0, 1, 489, 490, 600, 5000):
        got = one.select(scalar.chunks(F.expr(f"sequence(0, {n})"), hypothesis=20)).first()[0]
        assert got == A.windows(list(range(n + 1)), 20)
    assert len(A.windows(list(range(489)), 20)) == 1 and A.windows([], 20) == [[]]
    with pytest.raises(ValueError):
        A.windows([1], 450)


def test_cost_of_length_order_is_hidden():
    rows = [[1, 2, 3], [4], [5, 6], []]
    out = A.by_length(rows, lambda ids, mask: (ids * mask).sum(1, keepdims=True), 0, batch=2)
    assert out.ravel().tolist() == [6, 4, 11, 0]
    assert A.entailment_index({"neutral": 0, "ENTAILMENT": 2}) == 2
    with pytest.raises(KeyError):
        A.entailment_index({"no": 0})


QUESTIONS = QuestionSet((Question("q1", "noul", "is it?", ("it is",)), Question("q2", "score", "how?", ("low", "high"), ("low", "high"))), Question("d", "noul", "direct?", ("yes",)))


def call(text, questions, model):
    if "refuse" in text:
        raise A.AnswererHttpError(422)
    return {"model": model, "answers": {"q1": {"type": "noul", "noul": 0.7}, "q2": {"type": "score", "probabilities": {"0": 0.4, "1": 0.6}}}, "usage": {"input_tokens": 10}}


def test_hosted_run_resumes_and_exports(spark, tmp_path):
    rows = spark.createDataFrame([("1", "same"), ("2", "same"), ("3", "other"), ("4", "refuse me"), ("5", None)], "complaint_id string, narrative string")
    cache = AnswerCache.open(spark, str(tmp_path / "cache"))
    assert A.run_hosted(rows, cache, QUESTIONS, call, "m1") == {"answered": 2, "refused": 1}
    assert A.run_hosted(rows, cache, QUESTIONS, call, "m1") == {"answered": 0, "refused": 0}
    out = A.export_hosted(rows, cache.read()).withColumn("v", A.hosted_vector(QUESTIONS))
    got = {r["complaint_id"]: (r["v"], r["error"]) for r in out.collect()}
    assert got["1"] == got["2"] == ([0.7, 0.6], None) and got["4"][1] == "422" and got["5"][1] == "missing"
    Backup(cache, str(tmp_path / "copy"), 0).tick()
    again = AnswerCache.open(spark, str(tmp_path / "new"), str(tmp_path / "copy"))
    assert again.read().count() == 3
    with pytest.raises(A.ModelVersionError):
        A.ask("x", [], lambda *_: {"model": "m2"}, "m1")
    with pytest.raises(A.TooManyFailures):
        A.check_failure_rate(2, 100, "hosted")
    A.check_failure_rate(1, 100, "hosted")


class Tok:
    cls, sep, pad = 1, 2, 0

    def __call__(self, text):
        return [3 + len(w) for w in text.split()]


def test_entailment_and_vectors(spark):
    rows = spark.createDataFrame([("1", "a bb ccc"), ("2", "w " * 1500), ("3", None)], "complaint_id string, narrative string")
    forward = lambda ids, mask: np.stack([(ids * mask).sum(1) % 11, mask.sum(1) % 7, ids[:, 0]], 1).astype(float)
    got = A.entailment_answers(rows, QUESTIONS, Tok(), forward, {"entails": 0, "neutral": 1, "no": 2}, "complaint_id", "narrative")
    assert {r["id"]: r["max_chunks"] for r in got.collect()} == {"1": 1, "2": 4}
    wide = A.export_entailment(rows, got, QUESTIONS).collect()
    assert {r["complaint_id"]: r["ok"] for r in wide} == {"1": True, "2": True, "3": False}
    assert set(QUESTIONS.columns()) == {"q1", "q2@0", "q2@1"} <= set(wide[0].asDict())
    vec = A.embeddings(rows, Tok(), lambda ids, mask: np.stack([mask.sum(1), mask.sum(1)], 1).astype(float), 2, "complaint_id", "narrative").collect()
    assert {r["key"]: len(r["vector"]) for r in vec} == {"1": 2, "2": 2}


def test_questions(tmp_path):
    a = QuestionSet(QUESTIONS.questions[::-1], QUESTIONS.direct)
    assert a.digest() == QUESTIONS.digest() and len(QUESTIONS.payload()) == 3
    (tmp_path / "q.yaml").write_text("status: draft\nquestions:\n- {id: a, type: noul, question: is it, nli_hypothesis: it is, criteria: {true: y, false: n}}\n")
    got = load_questions(str(tmp_path / "q.yaml"))
    assert got.questions[0].criteria == (("false", "n"), ("true", "y"))
    (tmp_path / "q.yaml").write_text("status: frozen\nquestions:\n- {id: a, type: noul, question: is it, nli_hypothesis: it is}\n")
    with pytest.raises(ValueError, match="frozen"):
        load_questions(str(tmp_path / "q.yaml"))
    with pytest.raises(ValueError):
        Question("x", "score", "t", ("a",), ("a",))


def test_vocabulary(spark):
    train = spark.createDataFrame([("A", "x"), ("A", None), ("B", "y"), ("C", "y")], "company string, state string")
    vocab = features.fit_vocabulary(train, ("company", "state"), "company", 2)
    got = {(r["field"], r["value"]): r["code"] for r in vocab.collect()}
    assert got == {("company", "A"): 0, ("company", "B"): 1, ("company", "other"): 2, ("state", ""): 0, ("state", "other"): 1, ("state", "x"): 2, ("state", "y"): 3}
    new = spark.createDataFrame([("Z", "x"), (None, "q")], "company string, state string")
    rows = features.encode(new, vocab, ("company", "state"), None).select("company_code", "state_code").collect()
    assert {tuple(r) for r in rows} == {(2, 2), (2, 1)}


def test_models():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.3 * rng.normal(size=400) > 0.5).astype(float)
    assert ap(y[300:], models.LogReg(1.0).fit(x[:300], y[:300]).predict(x[300:])) > 0.7
    assert ap(y[300:], models.Booster(7, 5, 100, 0.1).fit(x[:300], y[:300]).predict(x[300:])) > 0.85
    wide = rng.normal(size=(60, 300))
    noise = rng.integers(0, 2, 60).astype(float)
    own, _ = models.stacked(wide, noise, [wide], 1.0)
    assert ap(noise, models.LogReg(1.0).fit(wide, noise).predict(wide)) > 0.95 and ap(noise, own) < 0.8
    assert models.schedule(300, 20_000) == (300, 10) and models.schedule(10_000, 20_100) == (10_000, 5) and models.schedule(10_000, 19_000) == (19_000, 1)
    got = models.draw(np.array([1] * 5 + [0] * 95), 10, 3)
    assert len(set(got)) == 10 and (got < 5).sum() == 1 and models.choose_variant(0.2, 0.2) == "stacked"


def test_guard_and_log(tmp_path):
    yes = lambda args, cwd: (0, "M x" if args[0] == "status" else "abc")
    no = lambda args, cwd: (1, "")
    with pytest.raises(guard.GuardError):
        guard.load_test_labels(None, "x", "tag", ".", no)
    guard.append_scoring_log(tmp_path / "log.csv", ".", yes)
    guard.append_scoring_log(tmp_path / "log.csv", ".", yes)
    lines = (tmp_path / "log.csv").read_text().splitlines()
    assert lines[0] == "utc,commit,dirty,diff_hash" and len(lines) == 3


def test_report_end_to_end(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = []
    for split, n in (("train", 80), ("dev", 40), ("test", 60)):
        for i in range(n):
            y = int(i % 4 == 0)
            rows.append((split, f"{split}{i:03d}", y, f"word{y} and more text {i % 7}", [float(i % 5), y + rng.normal()], [y + rng.normal(), 0.0], [2 * y + rng.normal()]))
    built = spark.createDataFrame(rows, "split string, complaint_id string, y int, text string, tab array<double>, local array<double>, hosted array<double>")
    out = run_report(built, ("tab", "local", "hosted"), str(tmp_path), (40,), boots=20)
    assert {r["arm_id"] for r in out["rows"]} == {0, 1, 2, 5, 6, 8, 9}
    base = next(r for r in out["rows"] if r["arm_id"] == 0)
    assert base["pr_auc"] == pytest.approx(0.25) and base["roc_auc"] == pytest.approx(0.5)
    assert json.loads((tmp_path / "headline.json").read_text())["hosted_vs_local"]["verdict"]
    assert (tmp_path / "results.csv").read_text().startswith("arm_id,arm,")


def test_grid_is_registered_at_the_plans_sizes(spark, tmp_path, monkeypatch):
    """Rows drawn, label counts and boots of ``arm_grid`` and ``arm_results``."""
    fields = ("company", "product", "sub_product", "issue", "sub_issue", "state", "tags", "submitted_via")
    rows = [(f"{i}", f"fee called {i}", i % 2, datetime.date(2022, 1, 1), *("a" for _ in fields)) for i in range(30)]
    table = spark.createDataFrame(rows, "complaint_id string, narrative string, y int, date_received date, " + ", ".join(f"{f} string" for f in fields))
    for s in ("train", "dev"):
        table.write.parquet(f"{tmp_path}/split_{s}.parquet")
    table.drop("y").write.parquet(f"{tmp_path}/split_test.parquet")
    table.select("complaint_id", "y").write.parquet(f"{tmp_path}/test_labels.parquet")
    drawn, counts, boots = [], [], []
    sample = prepare.portable_sample
    monkeypatch.setattr(prepare, "portable_sample", lambda df, n, *a: drawn.append(n) or sample(df, n, *a))
    small = registry._built(spark, str(tmp_path), {"train": 20, "dev": 10, "test": 5})
    assert {r["split"]: r["count"] for r in small.groupBy("split").count().collect()} == drawn_sizes(drawn)
    drawn.clear()
    scored = spark.createDataFrame([(0, 300, 300, 0, "1", 1, 0.5)], "arm_id int, n_labels int, labels_drawn int, seed int, complaint_id string, y int, score double")
    monkeypatch.setattr(models, "run_grid", lambda built, arms, labels, parts: counts.append(labels) or scored)
    monkeypatch.setattr(registry, "grid_bootstrap", lambda scores, n=BOOTSTRAPS: boots.append(n))
    monkeypatch.setattr(registry, "result_rows", lambda *a: [])
    registry.arm_results(spark, str(tmp_path))
    assert drawn_sizes(drawn) == SPLIT_ROWS
    assert counts == [LABEL_COUNTS] and boots == [BOOTSTRAPS]


def drawn_sizes(drawn):
    return dict(zip(("train", "dev", "test"), drawn))
