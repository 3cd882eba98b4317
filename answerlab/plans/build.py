"""From frozen splits and exported answers to the table that the report fits on, and the whole study in one call."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlab.config import BOOTSTRAPS, LABEL_COUNTS
from answerlab.functions.scalar import all_finite
from answerlab.operators import features
from answerlab.operators.answerers import entailment_vector, hosted_vector
from answerlab.operators.questions import QuestionSet
from answerlab.plans import guard, report
from answerlab.session import materialize

PARTS = ("tab", "emb", "local", "hosted", "direct")


@dataclass
class Built:
    """The kept rows with their feature parts, and what the report says about how they came about."""

    table: DataFrame
    failures: dict[str, dict[str, int]]
    rows_used: dict[str, int]
    mean_input_tokens: float
    mean_seconds: float


def build(rows: DataFrame, labels: DataFrame, hosted: DataFrame, local: DataFrame, vectors: DataFrame, questions: QuestionSet, id_col: str = "complaint_id") -> Built:
    """Join splits, labels and the three answerers' answers; keep the rows that all of them answered.

    ``rows`` holds all splits (``split``, the candidates' columns); ``hosted`` and ``local`` are exports, ``vectors`` ``(id, vector)``.
    Raises if an answerer failed on more than 1 % of the test rows.
    """
    direct = F.from_json("payload", "answers map<string, struct<noul double>>")["answers"]
    asked = hosted.select(
        id_col, hosted_vector(questions).alias("vector"), F.col("payload").isNotNull().alias("ok"), F.col("input_tokens"),
        (F.array(direct[questions.direct.id]["noul"]) if questions.direct else F.array().cast("array<double>")).alias("direct"),
    )
    read = local.select(id_col, entailment_vector(questions).alias("vector"), "ok", "max_chunks", "seconds")
    emb = vectors.select(id_col, F.transform("vector", lambda v: v.cast("double")).alias("vector"), all_finite(F.col("vector")).alias("ok"))
    every = features.assemble(rows, labels, {"hosted": asked, "local": read, "emb": emb}, id_col)
    every = every.join(asked.select(id_col, "direct", "input_tokens"), id_col, "left").join(read.select(id_col, "max_chunks", "seconds"), id_col, "left")
    every = materialize(every)
    counts = features.failures(every, {a: f"{a}_ok" for a in ("hosted", "local", "emb")})
    features.stop_on_failures(counts)
    failures: dict[str, dict[str, int]] = {}
    for r in counts.collect():  # one row an answerer and split
        failures.setdefault(r["answerer"], {})[r["split"]] = r["failed"]
    kept = every.where(features.shared_mask(F.col("hosted_ok"), F.col("local_ok"), F.col("emb_ok")))
    vocabulary = features.fit_vocabulary(rows.where("split = 'train'"))
    table = materialize(
        features.tabular_vectors(kept, vocabulary)
        .withColumn("single_window", F.col("max_chunks") == 1)
        .select("split", id_col, "date_received", "y", F.col("narrative").alias("text"), *PARTS, "single_window", "input_tokens", "seconds")
    )
    means = table.agg(F.avg("input_tokens").alias("t"), F.avg("seconds").alias("s")).first()
    used = {r["split"]: r["count"] for r in table.groupBy("split").count().collect()}
    return Built(table, failures, used, means["t"] or 0.0, means["s"] or 0.0)


def check_dev(rows: DataFrame, hosted: DataFrame, local: DataFrame, questions: QuestionSet, id_col: str = "complaint_id") -> DataFrame:
    """``(answerer, question, n, mean, std, broken)`` of the dev rows' encoded answers; labels take no part."""
    ids = F.array(*(F.lit(q.id) for q in questions.questions))
    dev, out = rows.where("split = 'dev'").select(id_col), None
    for name, df, ok, vector in (("hosted", hosted, F.col("payload").isNotNull(), hosted_vector(questions)), ("local", local, F.col("ok"), entailment_vector(questions))):
        answers = dev.join(df, id_col, "left").select(F.explode(F.arrays_zip(ids.alias("question"), F.when(ok, vector).alias("value"))).alias("x"))
        part = features.spread_report(answers.select(F.lit(name).alias("answerer"), "x.question", "x.value"), ["answerer", "question"], "value")
        out = part if out is None else out.unionByName(part)
    return out


def run_study(
    spark: SparkSession,
    frozen: str,
    out: str,
    questions: QuestionSet,
    vectors: DataFrame,
    tag: str,
    cwd: str = ".",
    run: guard.Runner = guard.git,
    label_counts: tuple[int, ...] = LABEL_COUNTS,
    boots: int = BOOTSTRAPS,
) -> dict:
    """The guarded report over a frozen folder: test labels open only after the plan's tag, and the run is logged before anything is fitted."""
    labels = guard.load_test_labels(spark, f"{frozen}/test_labels.parquet", tag, cwd, run)
    Path(out).mkdir(parents=True, exist_ok=True)
    log = guard.append_scoring_log(Path(out) / "scoring_log.csv", cwd, run)
    rows = None
    for s in ("train", "dev", "test"):
        part = spark.read.parquet(f"{frozen}/{s}.parquet").withColumn("split", F.lit(s))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    hosted, local = (spark.read.parquet(f"{frozen}/{n}_answers.parquet") for n in ("hosted", "local"))
    built = build(rows, labels, hosted, local, vectors, questions)
    kept = built.table.where("split = 'test'").select("complaint_id")
    yes_no = [(q.id, i) for i, q in enumerate(questions.questions) if q.type != "score"]
    quality = {}
    for name, vector in (("hosted", hosted_vector(questions)), ("local", entailment_vector(questions))):
        df = kept.join({"hosted": hosted, "local": local}[name], "complaint_id")
        pairs = F.explode(F.array(*(F.struct(F.lit(q).alias("question_id"), vector[i].alias("p")) for q, i in yes_no))).alias("x")
        quality[name] = report.answer_quality(df.select("complaint_id", pairs).select("complaint_id", "x.*"), Path(frozen) / "handlabels.csv") if yes_no else {"status": "no yes/no questions"}
    facts = {
        "failures": built.failures,
        "rows_used": built.rows_used,
        "compute": {"mean_input_tokens": built.mean_input_tokens, "local_minutes_per_10k": built.mean_seconds * 10_000 / 60},
        "answer_quality": quality,
        "scoring_log": log,
    }
    return report.run_report(built.table, PARTS, out, label_counts, boots, facts=facts)
