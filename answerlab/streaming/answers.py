"""The resumable answer run as a stream: each micro-batch answers the texts the cache still lacks.

An extension of the batch run, with the same cache semantics: a batch that is repeated after a failure finds its
answers in the cache, so every distinct text is asked once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from answerlab.operators.answer_cache import AnswerCache
from answerlab.operators.answerers import Call, run_hosted
from answerlab.operators.questions import QuestionSet


def answer_stream(rows: DataFrame, cache: AnswerCache, questions: QuestionSet, call: Call, model: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start answering a stream of ``complaint_id, narrative`` rows; with ``once`` it ends when the source is read."""

    def each(batch: DataFrame, _: int) -> None:
        run_hosted(batch, cache, questions, call, model)

    out = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
