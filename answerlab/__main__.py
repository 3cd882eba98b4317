"""Commands: ``python -m answerlab <command> …``.  Answerers and embeddings are named as ``module:function``; none is built in."""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlab.config import SPLIT_ROWS
from answerlab.operators import answerers, prepare
from answerlab.operators.answer_cache import AnswerCache, Backup
from answerlab.operators.questions import YES_NO, load_questions
from answerlab.plans import build, report
from answerlab.session import local_session
from answerlab.sources.tables import read_export, write_parquet


def named(spec: str):
    """The object that ``module:name`` says."""
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def split_rows(spark: SparkSession, frozen: str, columns: tuple[str, ...] = ("complaint_id", "narrative")) -> DataFrame:
    out = None
    for s in ("train", "dev", "test"):
        part = spark.read.parquet(f"{frozen}/{s}.parquet").select(*columns, F.lit(s).alias("split"))
        out = part if out is None else out.unionByName(part)
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="answerlab")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *needed: str, **given) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        for n in needed:
            c.add_argument(f"--{n}", required=True)
        for n, v in given.items():
            c.add_argument(f"--{n.replace('_', '-')}", default=v, type=type(v) if v is not None else str)
        return c

    f = command("filter", "raw export to candidates", "csv", "out", "positive")
    f.add_argument("--product", action="append", required=True)
    f.add_argument("--response", action="append", required=True)
    command("rates", "label rates per product", "candidates")
    command("split", "time split, near-duplicates removed, samples drawn", "candidates", "out").add_argument("--no-sample", action="store_true")
    command("handlabels", "sheet of test rows to label by hand", "frozen", "questions")
    r = command("run", "answer every split row; goes on from the cache", "frozen", "questions", "cache", "model", "plugin", backup=None, workers=8)
    r.add_argument("answerer", choices=["hosted", "local"])
    r.add_argument("--limit", type=int, help="the first rows alone, to measure throughput")
    command("export", "cache to the frozen folder's answer tables", "frozen", "questions", "cache")
    command("check-dev", "questions whose dev answers hardly vary", "frozen", "questions")
    command("probe", "longest texts against the hosted answerer", "candidates", "plugin", "model", n=20)
    command("calibrate", "size of the equivalence margin", "frozen")
    command("report", "the guarded report", "frozen", "out", "questions", "vectors", "tag", repo=".")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> object:
    args = parser().parse_args(argv)
    spark = spark or local_session()
    out: object = None
    if args.command == "filter":
        rows = prepare.filter_candidates(read_export(spark, args.csv), tuple(args.product), tuple(args.response), args.positive)
        write_parquet(rows, args.out)
        out = spark.read.parquet(args.out).count()
    elif args.command == "rates":
        out = [r.asDict() for r in prepare.group_rates(spark.read.parquet(args.candidates)).collect()]
    elif args.command == "split":
        splits = prepare.split_by_time(spark.read.parquet(args.candidates), None if args.no_sample else SPLIT_ROWS)
        out = prepare.write_splits(splits, args.out)
    elif args.command == "handlabels":
        asked = [(q.id, q.text) for q in load_questions(args.questions).of_type(YES_NO)]
        out = str(prepare.hand_label_sheet(spark.read.parquet(f"{args.frozen}/test.parquet"), asked, f"{args.frozen}/handlabels.csv"))
    elif args.command == "run":
        rows, questions = split_rows(spark, args.frozen), load_questions(args.questions)
        rows = rows if args.limit is None else rows.limit(args.limit)
        cache = AnswerCache.open(spark, args.cache, args.backup)
        backup, plugin = Backup(cache, args.backup) if args.backup else None, named(args.plugin)
        if args.answerer == "hosted":
            out = answerers.run_hosted(rows, cache, questions, plugin, args.model, workers=args.workers, backup=backup)
        else:
            tokenizer, forward, labels = plugin()
            out = answerers.run_entailment(rows, cache, questions, tokenizer, forward, labels, args.model, backup=backup)
    elif args.command == "export":
        rows, questions, cache = split_rows(spark, args.frozen), load_questions(args.questions), AnswerCache(spark, args.cache).read()
        of = lambda a: cache.where((F.col("answerer") == a) & (F.col("question_set_hash") == questions.digest()))
        tables = {"hosted": answerers.export_hosted(rows, of("hosted")), "local": answerers.export_entailment_cache(rows, of("local"), questions)}
        for name, df in tables.items():
            write_parquet(df, f"{args.frozen}/{name}_answers.parquet")
        out = answerers.missing_counts({n: spark.read.parquet(f"{args.frozen}/{n}_answers.parquet") for n in tables})
    elif args.command == "check-dev":
        hosted, local = (spark.read.parquet(f"{args.frozen}/{n}_answers.parquet") for n in ("hosted", "local"))
        found = build.check_dev(split_rows(spark, args.frozen), hosted, local, load_questions(args.questions))
        out = [r.asDict() for r in found.orderBy("question", "answerer").collect()]  # one row a question and answerer
    elif args.command == "probe":
        rows = prepare.in_dates(spark.read.parquet(args.candidates), "train")
        out = answerers.probe_longest(rows, args.n, named(args.plugin), args.model)
    elif args.command == "calibrate":
        out = report.calibrate_margin(*(spark.read.parquet(f"{args.frozen}/{s}.parquet") for s in ("train", "dev")))
    elif args.command == "report":
        got = build.run_study(spark, args.frozen, args.out, load_questions(args.questions), spark.read.parquet(args.vectors), args.tag, args.repo)
        out = got["headline"]["hosted_vs_local"]
    print(json.dumps(out, indent=2, default=str))
    return out


if __name__ == "__main__":
    main()
