"""The question set: model, validation, canonical hash, request payload, and its tables."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from answerlab.sources.tables import load_yaml

YES_NO, SCORE = "noul", "score"
#: Questions of each type in a frozen set.
FROZEN_COUNTS = {YES_NO: 15, SCORE: 5}


@dataclass(frozen=True)
class Question:
    """One question: yes/no with one hypothesis, or a score over ordered levels with a hypothesis each."""

    id: str
    type: str
    text: str
    hypotheses: tuple[str, ...]
    levels: tuple[str, ...] = ()
    criteria: tuple[tuple[str, str], ...] = ()

    def __post_init__(self) -> None:
        if not self.id:
            raise ValueError("a question needs an id")
        if self.type not in FROZEN_COUNTS:
            raise ValueError(f"{self.id}: unknown type {self.type!r}")
        if self.type == YES_NO and (len(self.hypotheses) != 1 or self.levels):
            raise ValueError(f"{self.id}: a yes/no question has one hypothesis and no levels")
        if self.type == SCORE and not 2 <= len(self.levels) <= 10:
            raise ValueError(f"{self.id}: a score has two to ten levels")
        if self.type == SCORE and len(self.hypotheses) != len(self.levels):
            raise ValueError(f"{self.id}: one hypothesis per level")

    def request(self) -> dict:
        out: dict = {"id": self.id, "type": self.type, "question": self.text}
        if self.levels:
            out["levels"] = list(self.levels)
        if self.criteria:
            out["criteria"] = dict(self.criteria)
        return out

    def canonical(self) -> dict:
        return self.request() | {"hypotheses": list(self.hypotheses)}


@dataclass(frozen=True)
class QuestionSet:
    questions: tuple[Question, ...]
    direct: Question | None = None
    status: str = field(default="draft")

    def of_type(self, kind: str) -> list[Question]:
        return [q for q in self.questions if q.type == kind]

    def digest(self) -> str:
        """sha256 of the canonical JSON; the order of the questions does not count."""
        body = {"questions": sorted((q.canonical() for q in self.questions), key=lambda q: q["id"]), "direct": self.direct.canonical() if self.direct else None}
        return hashlib.sha256(json.dumps(body, sort_keys=True, ensure_ascii=False).encode()).hexdigest()

    def payload(self) -> list[dict]:
        """What the hosted answerer is asked: all questions and the direct one."""
        return [q.request() for q in (*self.questions, *([self.direct] if self.direct else []))]

    def columns(self) -> list[str]:
        """Answer columns: the id of a yes/no question, ``id@level`` of a score."""
        return [c for q in self.questions for c in ([q.id] if q.type == YES_NO else [f"{q.id}@{k}" for k in range(len(q.levels))])]

    def hypotheses(self) -> list[tuple[str, str]]:
        """(answer column, hypothesis) in question order; the direct question has none here."""
        return list(zip(self.columns(), (h for q in self.questions for h in q.hypotheses)))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(q.id, q.type, q.text, list(q.levels), list(q.hypotheses), dict(q.criteria)) for q in self.questions]
        return spark.createDataFrame(rows, "id string, type string, text string, levels array<string>, hypotheses array<string>, criteria map<string,string>")


def question_from(raw: dict, text_key: str, one_key: str = "nli_hypothesis", many_key: str = "nli_hypotheses") -> Question:
    """A question of a YAML entry; ``true`` and ``false`` criteria may come as booleans."""
    if not isinstance(raw, dict) or not raw.get("id") or not raw.get(text_key):
        raise ValueError(f"a question needs an id and a {text_key!r}: {raw!r}")
    levels = tuple(str(x) for x in raw.get("levels") or ())
    hypotheses = tuple(raw[many_key]) if raw.get(many_key) else (raw[one_key],) if raw.get(one_key) else ()
    criteria = tuple(sorted((str(k).lower(), str(v)) for k, v in (raw.get("criteria") or {}).items()))
    return Question(str(raw["id"]), str(raw.get("type")), str(raw[text_key]), hypotheses, levels, criteria)


def load_questions(path: str, text_key: str = "question") -> QuestionSet:
    """A question file.  Ids must be unique, and a frozen set must have its fixed number of each type."""
    raw = load_yaml(path)
    qs = tuple(question_from(q, text_key) for q in raw.get("questions") or ())
    direct = question_from(raw["direct"], text_key) if raw.get("direct") else None
    ids = [q.id for q in qs] + ([direct.id] if direct else [])
    if len(set(ids)) != len(ids):
        raise ValueError("two questions share an id")
    out = QuestionSet(qs, direct, str(raw.get("status", "draft")))
    if out.status == "frozen" and {k: len(out.of_type(k)) for k in FROZEN_COUNTS} != FROZEN_COUNTS:
        raise ValueError(f"a frozen set has {FROZEN_COUNTS[YES_NO]} yes/no questions and {FROZEN_COUNTS[SCORE]} scores")
    return out
