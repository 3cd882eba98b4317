"""The report: grid, bootstrap, comparisons, subsets, answer quality, outputs."""

from __future__ import annotations

import math
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlab.config import BOOTSTRAPS, HALF_WIDTH_MAX, LABEL_COUNTS, MARGIN, TABULAR_FIELDS
from answerlab.functions.scalar import half_year
from answerlab.operators.metrics import accuracy, calibration_error, roc_auc
from answerlab.operators.features import fit_vocabulary, tabular_vectors
from answerlab.operators.models import ARMS, CALIBRATION_ARM, average_precision, run_grid, sample_tables, select_variant
from answerlab.session import materialize
from answerlab.sources.tables import read_sheet, write_json, write_sheet

RESULT_COLUMNS = ["arm_id", "arm", "n_labels", "labels_drawn", "seeds", "pr_auc", "pr_auc_lo", "pr_auc_hi", "roc_auc", "lift", "lift_lo", "lift_hi", "chart"]
#: The arms of the headline comparison (hosted against local answers) and the arms it is set beside.
HOSTED, LOCAL, EMBEDDING, DIRECT = 9, 8, 4, 7


def grid_bootstrap(scores: DataFrame, boots: int = BOOTSTRAPS, seed: int = 0, id_col: str = "complaint_id") -> DataFrame:
    """``(arm_id, n_labels, boot, pr_auc)``: all arms on the same resamples, each resample with one of the arm's seeds.

    The resample of a boot comes from its own generator, so every task makes the same one; a group is the test sample
    times the seeds, both fixed by the plan.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        arm, n = int(pdf.arm_id.iloc[0]), int(pdf.n_labels.iloc[0])
        wide = pdf.sort_values(["seed", id_col])
        seeds = sorted(wide.seed.unique())
        score = wide.score.to_numpy().reshape(len(seeds), -1)
        y = wide.y.to_numpy()[: score.shape[1]]
        out = []
        for b in range(boots):
            rng = np.random.default_rng([seed, b])
            pick = int(rng.integers(1 << 30)) % len(seeds)
            w = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y))
            out.append(average_precision(y, score[pick], w))
        return pd.DataFrame({"arm_id": arm, "n_labels": n, "boot": range(boots), "pr_auc": out})

    return scores.groupBy("arm_id", "n_labels").applyInPandas(run, "arm_id int, n_labels int, boot int, pr_auc double")


def interval(values: np.ndarray) -> tuple[float, float]:
    ok = values[np.isfinite(values)]
    return (float(np.quantile(ok, 0.025)), float(np.quantile(ok, 0.975))) if len(ok) else (math.nan, math.nan)


def say(lo: float, hi: float, margin: float = MARGIN, first: str = "first better", second: str = "second better") -> str:
    """Verdict of an interval: significance before equivalence."""
    if lo > 0:
        return first
    if hi < 0:
        return second
    return "equivalent" if lo >= -margin and hi <= margin else "inconclusive"


def result_rows(scores: DataFrame, boots: DataFrame) -> list[dict]:
    """One row per arm and label count: seed means, intervals, lift over the tabular arm."""

    def ap(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[:1][["arm_id", "n_labels", "labels_drawn", "seed"]].copy()
        first["pr_auc"] = average_precision(pdf.y.to_numpy(), pdf.score.to_numpy())
        return first

    per = scores.groupBy("arm_id", "n_labels", "seed").applyInPandas(ap, "arm_id int, n_labels int, labels_drawn int, seed int, pr_auc double")
    roc = roc_auc(scores, ["arm_id", "n_labels", "seed"]).groupBy("arm_id", "n_labels").agg(F.avg("roc_auc").alias("roc_auc"))
    mean = per.groupBy("arm_id", "n_labels").agg(F.max("labels_drawn").alias("labels_drawn"), F.count(F.lit(1)).alias("seeds"), F.avg("pr_auc").alias("pr_auc"))
    table = mean.join(roc, ["arm_id", "n_labels"]).toPandas()
    bs = boots.toPandas()
    names = {a.id: a.name for a in ARMS}
    base = {r.n_labels: r.pr_auc for r in table[table.arm_id == 1].itertuples()}
    rows = []
    wide = bs.pivot(index="boot", columns=["arm_id", "n_labels"], values="pr_auc") if len(bs) else None
    shown = {a.id for a in ARMS if a.chart}
    for r in table.sort_values(["arm_id", "n_labels"]).itertuples():
        mine = wide[(r.arm_id, r.n_labels)].to_numpy()
        lo, hi = interval(mine)
        lift = interval(mine - wide[(1, r.n_labels)].to_numpy()) if r.n_labels in base else (None, None)
        rows.append({
            "arm_id": r.arm_id, "arm": names.get(r.arm_id, str(r.arm_id)), "n_labels": r.n_labels, "labels_drawn": r.labels_drawn, "seeds": r.seeds,
            "pr_auc": r.pr_auc, "pr_auc_lo": lo, "pr_auc_hi": hi, "roc_auc": r.roc_auc, "lift": r.pr_auc - base[r.n_labels] if r.n_labels in base else None,
            "lift_lo": lift[0], "lift_hi": lift[1], "chart": r.arm_id in shown,
        })
    return rows


def compare(rows: list[dict], boots: pd.DataFrame, a: int, b: int, n: int) -> dict:
    """Difference of two arms' seed means with the interval of the paired resamples."""
    point = {r["arm_id"]: r["pr_auc"] for r in rows if r["n_labels"] == n}
    wide = boots[boots.n_labels == n].pivot(index="boot", columns="arm_id", values="pr_auc")
    if a not in point or b not in point or a not in wide or b not in wide:
        return {"delta": None, "lo": None, "hi": None, "verdict": "arm missing"}
    lo, hi = interval((wide[a] - wide[b]).to_numpy())
    return {"delta": point[a] - point[b], "lo": lo, "hi": hi, "verdict": say(lo, hi)}


def subset_intervals(scores: DataFrame, by, arms: tuple[int, ...], boots: int, seed: int = 0, n: int | None = None, id_col: str = "complaint_id") -> DataFrame:
    """Per subset ``(subset, rows, value, lo, hi, status)`` of one arm's average precision, or of the difference of two arms.

    Each subset has its own resamples; of two arms both are measured on the same ones, each with one of the arms' seeds.  ``status`` is 'too few
    rows' where only one class is left, else 'ok', or the verdict of a difference.  A null subset is left out.
    """
    first, rest = arms[0], arms[1:]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index=id_col, columns=["arm_id", "seed"], values="score").sort_index()
        y = pdf.groupby(id_col).y.first().sort_index().to_numpy()
        out = {"subset": pdf.subset.iloc[0], "rows": len(y), "value": None, "lo": None, "hi": None, "status": "too few rows"}
        if y.min() != y.max():
            each = {a: wide[a].to_numpy().T for a in arms}

            def value(pick: int | None, w: np.ndarray | None) -> float:
                of = lambda a: np.mean([average_precision(y, s, w) for s in (each[a] if pick is None else each[a][pick % len(each[a])][None])])
                return float(of(first) - sum(of(a) for a in rest))

            rng = np.random.default_rng(seed)
            draws = [value(int(rng.integers(1 << 30)), np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y))) for _ in range(boots)]
            lo, hi = interval(np.array(draws))
            out |= {"value": value(None, None), "lo": lo, "hi": hi, "status": say(lo, hi) if rest else "ok"}
        return pd.DataFrame([out])

    rows = scores.where(F.col("arm_id").isin(*arms)).withColumn("subset", by.cast("string")).where("subset is not null")
    rows = rows if n is None else rows.where(F.col("n_labels") == n)
    # a subset of the drawn test sample, whose size the plan fixes
    return rows.groupBy("subset").applyInPandas(run, "subset string, rows int, value double, lo double, hi double, status string")


def by_half_year(scores: DataFrame, dates: DataFrame, arm: int, boots: int, n: int | None = None, id_col: str = "complaint_id") -> DataFrame:
    """:func:`subset_intervals` of an arm per half year of receipt."""
    return subset_intervals(scores.join(dates, id_col), half_year(F.col("date_received")), (arm,), boots, n=n, id_col=id_col)


def answer_quality(answers: DataFrame, sheet: str | Path, id_col: str = "complaint_id") -> dict:
    """Accuracy per question and calibration error against hand labels, for rows still present."""
    if not Path(sheet).exists():
        return {"status": "no hand labels"}
    rows = read_sheet(sheet)
    blank = sum(not (r.get("label") or "").strip() for r in rows)
    if blank:
        return {"status": f"{blank} of {len(rows)} judgments unlabelled"}
    spark = answers.sparkSession
    truth = spark.createDataFrame([(r["complaint_id"], r["question_id"], int(r["label"])) for r in rows], f"{id_col} string, question_id string, y int")
    joined = answers.join(F.broadcast(truth), [id_col, "question_id"])
    per = {r["question_id"]: r["accuracy"] for r in accuracy(joined, ["question_id"]).collect()}
    return {"status": "ok", "accuracy": per, "ece": calibration_error(joined).first()["ece"]}


def calibrate_margin(train: DataFrame, dev: DataFrame, n_labels: int = 1_000, boots: int = BOOTSTRAPS, year: int = 2022, id_col: str = "complaint_id") -> dict:
    """The paired interval of a text score's gain over the tabular arm on one year of the training pool.

    Its half width says how fine a margin the test can resolve; 'within_limit' whether that is fine enough.
    """
    old = F.year("date_received") != year
    columns = [id_col, "narrative", "date_received", "y", *TABULAR_FIELDS]
    parts = {"train": train.where(old), "dev": dev, "test": train.where(~old)}
    rows = None
    for name, df in parts.items():
        part = df.select(*columns, F.lit(name).alias("split"))
        rows = part if rows is None else rows.unionByName(part)
    built = tabular_vectors(rows, fit_vocabulary(parts["train"])).withColumnRenamed("narrative", "text")
    scores = materialize(run_grid(built, (ARMS[1], CALIBRATION_ARM), (n_labels,), ("tab",), id_col=id_col))
    wide = grid_bootstrap(scores, boots, id_col=id_col).toPandas().pivot(index="boot", columns="arm_id", values="pr_auc")
    delta = (wide[CALIBRATION_ARM.id] - wide[1]).to_numpy()
    lo, hi = interval(delta)
    head = scores.agg(F.max("labels_drawn").alias("labels"), F.countDistinct("seed").alias("seeds"), F.countDistinct(id_col).alias("rows")).first()
    return {
        "pseudo_test_rows": head["rows"], "labels": head["labels"], "seeds": head["seeds"], "delta": float(np.nanmean(delta)), "lo": lo, "hi": hi,
        "half_width": (hi - lo) / 2, "within_limit": (hi - lo) / 2 <= HALF_WIDTH_MAX,
    }


def run_report(built: DataFrame, parts: tuple[str, ...], out: str, label_counts: tuple[int, ...] = LABEL_COUNTS, boots: int = BOOTSTRAPS, variant: str | None = None, facts: dict | None = None) -> dict:
    """Fit the grid, bootstrap, compare, and write ``results.csv``, ``headline.json`` and the chart's data.

    ``built`` may hold ``date_received`` and ``single_window`` beside what the grid needs; comparisons on subsets are
    made of what is there.  Without ``variant`` the form of the stacked arm is chosen on dev.  ``facts`` are added to the headline file.
    """
    n = 1_000 if 1_000 in label_counts else label_counts[0]
    chosen: dict = {"chosen": variant or "stacked"}
    if variant is None and {"tab", "emb"} <= set(parts):
        best, dev = select_variant(sample_tables(built, parts), n)
        chosen = {"chosen": best, "dev_pr_auc": dev, "at_n": n}
    scores = materialize(run_grid(built, ARMS, label_counts, parts, chosen["chosen"]))
    draws = materialize(grid_bootstrap(scores, boots))
    rows = result_rows(scores, draws)
    bs = draws.toPandas()
    have = {r["arm_id"] for r in rows}
    beside = {k: compare(rows, bs, HOSTED, EMBEDDING, k) for k in label_counts}
    headline = {
        "hosted_vs_local": compare(rows, bs, HOSTED, LOCAL, n) | {"n_labels": n, "margin": MARGIN},
        "hosted_vs_embedding": {str(k): v for k, v in beside.items()},
        "stops_beating_embedding": first_not_beating({k: v["lo"] for k, v in beside.items() if v["lo"] is not None}),
        "variant": chosen,
        "label_counts": list(label_counts),
        "boots": boots,
    }
    test = built.where("split = 'test'")
    table = lambda df: {r["subset"]: r.asDict() for r in df.collect()}  # noqa: E731  # one row a subset
    if "single_window" in built.columns and {HOSTED, LOCAL} <= have:
        one = scores.join(test.select("complaint_id", "single_window"), "complaint_id")
        headline["single_window"] = table(subset_intervals(one, F.when(F.col("single_window"), "single window"), (HOSTED, LOCAL), boots, n=n)).get("single window")
    if "date_received" in built.columns:
        dates = test.select("complaint_id", "date_received")
        if DIRECT in have:
            headline["direct_by_half_year"] = table(by_half_year(scores, dates, DIRECT, boots, n))
        if {HOSTED, LOCAL} <= have:
            late = F.when(F.year("date_received") == 2026, "2026")
            headline["hosted_vs_local_2026"] = table(subset_intervals(scores.join(dates, "complaint_id"), late, (HOSTED, LOCAL), boots, n=n)).get("2026")
    headline |= facts or {}
    folder = Path(out)
    folder.mkdir(parents=True, exist_ok=True)
    write_sheet(rows, folder / "results.csv", RESULT_COLUMNS)
    write_json(headline, folder / "headline.json")
    chart = [{k: r[k] for k in ("arm", "n_labels", "pr_auc", "pr_auc_lo", "pr_auc_hi")} for r in rows if r["chart"]]
    write_sheet(chart, folder / "chart.csv", ["arm", "n_labels", "pr_auc", "pr_auc_lo", "pr_auc_hi"])
    render_chart(chart, folder / "chart.png")
    return {"rows": rows, "headline": headline}


def first_not_beating(lows: dict[int, float]) -> int | str | None:
    """The first label count after the first win at which the low end is not above 0; 'never beats' without a win, None if it keeps beating."""
    wins = [n for n, lo in lows.items() if lo > 0]
    after = [n for n, lo in lows.items() if wins and n > min(wins) and lo <= 0]
    return "never beats" if not wins else min(after, default=None)


def render_chart(points: list[dict], path: Path) -> bool:
    """The chart of the shown arms over label counts; False where no plotting library is at hand."""
    try:
        from matplotlib.backends.backend_agg import FigureCanvasAgg
        from matplotlib.figure import Figure
    except ImportError:
        return False
    fig = Figure(figsize=(8, 5))
    FigureCanvasAgg(fig)
    ax = fig.subplots()
    for arm, p in pd.DataFrame(points).groupby("arm", sort=False):
        ax.errorbar(p.n_labels, p.pr_auc, yerr=[(p.pr_auc - p.pr_auc_lo).clip(lower=0), (p.pr_auc_hi - p.pr_auc).clip(lower=0)], marker="o", label=arm)
    ax.set(xscale="log", xlabel="labels", ylabel="average precision (95 % interval)")
    ax.legend()
    fig.savefig(path)
    return True
