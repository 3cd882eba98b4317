from __future__ import annotations

import sys

from pyspark import cloudpickle

from answerlab.operators.answer_cache import AnswerCache
from answerlab.operators.questions import Question, QuestionSet
from answerlab.streaming.answers import answer_stream

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def call(text, questions, model):
    return {"model": model, "answers": {"q1": {"type": "noul", "noul": 0.5}}}


def test_stream_asks_each_text_once(spark, tmp_path):
    qs = QuestionSet((Question("q1", "noul", "is it?", ("it is",)),))
    cache = AnswerCache.open(spark, str(tmp_path / "cache"))
    src, schema = str(tmp_path / "in"), "complaint_id string, narrative string"
    for ids in (("1", "2"), ("2", "3")):
        spark.createDataFrame([(i, f"text {i}") for i in ids], schema).coalesce(1).write.mode("append").parquet(src)
        answer_stream(spark.readStream.schema(schema).parquet(src), cache, qs, call, "m1", str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r["complaint_id"] for r in cache.read().collect()) == ["1", "2", "3"]
