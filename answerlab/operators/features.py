"""Features: categorical codes, the shared validity mask, failure counts, assembly, the dev check."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerlab.config import BROKEN_STD, COMPANY_TOP_K, TABULAR_FIELDS
from answerlab.operators.answerers import check_failure_rate
from answerlab.session import materialize, small_enough

#: Fixed value: the code of values the training rows lack.
OTHER = "other"


def text_value(column):
    """A categorical value as text; null is the empty string."""
    return F.coalesce(column.cast("string"), F.lit(""))


def top_values(df: DataFrame, field: str, k: int = COMPANY_TOP_K) -> DataFrame:
    """The ``k`` commonest values ``(value, n)``, ties by value."""
    return df.groupBy(text_value(F.col(field)).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def fit_vocabulary(train: DataFrame, fields: tuple[str, ...] = TABULAR_FIELDS, top_field: str | None = "company", k: int = COMPANY_TOP_K) -> DataFrame:
    """``(field, value, code)``: the sorted distinct values of each field, 'other' among them, numbered from 0.

    Of ``top_field`` only the ``k`` commonest values stand for themselves.  Codes are numbered per field.
    """
    stacked = train.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), text_value(F.col(f)).alias("value")) for f in fields))).alias("x")).select("x.*").distinct()
    if top_field in fields:
        keep = top_values(train, top_field, k).select(F.lit(top_field).alias("field"), "value")
        stacked = stacked.where(F.col("field") != top_field).unionByName(keep)
    other = train.sparkSession.createDataFrame([(f, OTHER) for f in fields], "field string, value string")
    every = stacked.unionByName(other).distinct()
    return every.withColumn("code", (F.row_number().over(Window.partitionBy("field").orderBy("value")) - 1).cast("int"))


def max_codes(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.groupBy("field").agg(F.max("code").alias("max_code"))


def encode(rows: DataFrame, vocabulary: DataFrame, fields: tuple[str, ...] = TABULAR_FIELDS, date: str | None = "date_received") -> DataFrame:
    """``rows`` with an int column ``<field>_code`` per field, unseen values coded as 'other', and ``month``."""
    vocab = materialize(vocabulary)
    default = {r["field"]: r["code"] for r in vocab.where(F.col("value") == OTHER).collect()}  # one row a field
    light = small_enough(vocab, 200_000)
    if light:  # one row of a map a field, sent to all tasks: one pass over the rows whatever the fields
        maps = [F.map_from_entries(F.collect_list(F.when(F.col("field") == f, F.struct("value", "code")))).alias(f"_{f}") for f in fields]
        out = rows.join(F.broadcast(vocab.agg(*maps)))
        code = lambda f: F.coalesce(F.try_element_at(F.col(f"_{f}"), text_value(F.col(f))), F.lit(default[f]))
        out = out.select(*rows.columns, *(code(f).alias(f"{f}_code") for f in fields))
        return out.withColumn("month", F.month(date)) if date else out
    for f in fields:
        side = vocab.where(F.col("field") == f).select(F.col("value").alias(f"_{f}"), F.col("code").alias(f"{f}_code"))
        joined = rows.withColumn(f"_{f}", text_value(F.col(f))).join(side, f"_{f}", "left")
        rows = joined.drop(f"_{f}").withColumn(f"{f}_code", F.coalesce(f"{f}_code", F.lit(default[f])))
    return rows.withColumn("month", F.month(date)) if date else rows


def shared_mask(*oks):
    """Whether every answerer's answer is there."""
    out = F.lit(True)
    for ok in oks:
        out = out & F.coalesce(ok, F.lit(False))
    return out


def failures(rows: DataFrame, oks: dict[str, str], split: str = "split") -> DataFrame:
    """``(answerer, split, failed, total)``: rows without a valid answer."""
    long = rows.select(split, F.explode(F.array(*(F.struct(F.lit(a).alias("answerer"), F.coalesce(F.col(c), F.lit(False)).alias("ok")) for a, c in oks.items()))).alias("x"))
    return long.groupBy(F.col("x.answerer").alias("answerer"), split).agg(
        F.sum((~F.col("x.ok")).cast("int")).cast("bigint").alias("failed"), F.count(F.lit(1)).alias("total")
    )


def stop_on_failures(counts: DataFrame, split: str = "split") -> None:
    """Raise if an answerer failed on more than 1 % of the test rows; other splits don't stop a run."""
    for r in counts.where(F.col(split) == "test").collect():  # one row an answerer
        check_failure_rate(r["failed"], r["total"], r["answerer"])


def assemble(rows: DataFrame, labels: DataFrame, answers: dict[str, DataFrame], id_col: str = "complaint_id") -> DataFrame:
    """Rows of all splits with labels and one vector and ``<name>_ok`` per answerer, before the mask.

    ``answers`` maps a name to ``(id, vector, ok)``.  Test labels come from their own table; a test row without one is an error
    raised when the rows are used.
    """
    out = rows.join(labels.select(id_col, F.col("y").alias("_y"), F.lit(True).alias("_has")), id_col, "left")
    test = F.col("split") == "test"
    lost = F.raise_error(F.concat(F.lit("no label for test id "), F.col(id_col).cast("string"))).cast("int")
    out = out.withColumn("y", F.when(test & F.col("_has").isNull(), lost).when(test, F.col("_y")).otherwise(F.col("y"))).drop("_y", "_has")
    for name, df in answers.items():
        side = df.select(id_col, F.col("vector").alias(name), F.col("ok").alias(f"{name}_ok"))
        out = out.join(side, id_col, "left").withColumn(f"{name}_ok", F.coalesce(f"{name}_ok", F.lit(False)))
    return out


def spread_report(answers: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``(keys, n, mean, std, broken)``: population spread of answers; broken if none or flat."""
    ok = F.col(value).isNotNull()
    return answers.groupBy(*keys).agg(
        F.sum(ok.cast("int")).cast("bigint").alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
    ).withColumn("broken", (F.col("n") == 0) | (F.coalesce("std", F.lit(0.0)) < BROKEN_STD))


def mean_pool(vectors: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """``(keys, vector)``: element-wise mean of the vectors of a group, summed before the shuffle."""
    long = vectors.select(*keys, F.posexplode(vector).alias("_i", "_v"))
    mean = long.groupBy(*keys, "_i").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    return mean.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda e: e["_m"]).alias(vector))


def max_pool(scores: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``(keys, value, chunks)``: the greatest score over a text's windows."""
    return scores.groupBy(*keys).agg(F.max(value).alias(value), F.count(F.lit(1)).alias("chunks"))


def tabular_vectors(rows: DataFrame, vocabulary: DataFrame, fields: tuple[str, ...] = TABULAR_FIELDS) -> DataFrame:
    """``rows`` with the codes of their fields and the month as one array ``tab``."""
    coded = encode(rows, vocabulary, fields)
    tab = F.array(*(F.col(f"{f}_code").cast("double") for f in fields), F.col("month").cast("double"))
    return coded.withColumn("tab", tab).drop(*(f"{f}_code" for f in fields), "month")
