"""Registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlab.llm import mixing, neardup, overlap, packing, pii, reading, splitting
from answerlab.session import table

Query = Callable[[SparkSession, str], DataFrame]

#: Similarity from which two complaints are versions of one another (TESTDATA.md, p5_found).
VERSION_SIMILARITY = 0.6


def _overlaps(spark: SparkSession, d: str, coverage: bool = True) -> tuple[overlap.Overlaps, dict[str, DataFrame]]:
    sides = {"dev": table(spark, d, "split_dev"), "test": table(spark, d, "split_test")}
    return overlap.Overlaps(table(spark, d, "split_train"), sides, "complaint_id", "narrative", 0.8, coverage), sides


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Ids rise with the first receipt, so of two ids the training record's is the smaller."""
    found, _ = _overlaps(spark, d, coverage=False)
    return found.id_pairs()


def p1_coverage(spark: SparkSession, d: str) -> DataFrame:
    found, sides = _overlaps(spark, d)
    return overlap.coverage_records(found, sides, "complaint_id", "submitted_via").withColumnRenamed("id", "complaint_id")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    found, sides = _overlaps(spark, d)
    return overlap.overlap_report(overlap.coverage_records(found, sides, "complaint_id", "submitted_via"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    out = splitting.split_oversized(table(spark, d, "candidates"), "complaint_id", "narrative", limit=512, overlap=64)
    return out.withColumnRenamed("id", "complaint_id").dropDuplicates(["complaint_id", "piece", "piece_text"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    out = splitting.split_oversized(table(spark, d, "candidates"), "complaint_id", "narrative", limit=512, overlap=64)
    return out.select(F.col("id").alias("complaint_id"), "cut").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    items = pii.personal_information(table(spark, d, "candidates"), "complaint_id", "narrative", table(spark, d, "name_lexicon"))
    return items.withColumnRenamed("id", "complaint_id").where("complaint_id is not null")


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    out = pii.redacted(table(spark, d, "candidates"), "complaint_id", "narrative", table(spark, d, "name_lexicon"))
    return out.withColumnRenamed("id", "complaint_id").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neardup.near_duplicate_pairs(table(spark, d, "candidates"), "complaint_id", "narrative", VERSION_SIMILARITY)
    return pairs.select(F.col("id_a").alias("complaint_id_a"), F.col("id_b").alias("complaint_id_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    groups = neardup.near_duplicate_groups(table(spark, d, "candidates"), "complaint_id", "narrative", VERSION_SIMILARITY)
    return groups.withColumnRenamed("id", "complaint_id")


def p5_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """How far the forest shortened its prefixes: labels compared beyond the shortest length, per round of trees."""
    return neardup.Forest(table(spark, d, "candidates"), "complaint_id", "narrative", VERSION_SIMILARITY).prefix_lengths()


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), "doc_id", "text", capacity=512)


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p6_containers(spark, d))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.share_report(p7_mix(spark, d), table(spark, d, "mix_targets"))


def p7_deviation(spark: SparkSession, d: str) -> DataFrame:
    return mixing.deviations(p7_mix(spark, d))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "reading_labels")
    return reading.reading_levels(table(spark, d, "documents"), "doc_id", "text", labels, "doc_id", "level")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of level 5, the highest of the scale."""
    return _levels(spark, d).where("level = 5").select(F.col("id").alias("doc_id")).distinct()


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).withColumnRenamed("id", "doc_id").distinct()


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    return reading.level_profile(_levels(spark, d), table(spark, d, "documents"), "doc_id", "source")


def queries() -> dict[str, Query]:
    found = (p1_found, p2_found, p3_found, p5_found, p8_found)
    more = (p1_report, p1_coverage, p2_pieces, p3_redacted, p5_groups, p5_prefixes, p6_containers, p6_report, p7_mix, p7_shares, p7_deviation, p8_levels, p8_profile)
    return {f.__name__: f for f in found + more}


_WORDS = "list_filter(regexp_split_to_array(lower({}), '[ \\t\\n\\r]+'), lambda w: w <> '')"


def _similar_sql(rows: str, left: str, right: str, threshold: float) -> str:
    """CTEs ``r(side, id, k)`` of all rows and ``hit(ka, kb)`` of similar distinct texts of two sides; ``rows`` gives side, id and text."""
    return f"""WITH w AS (SELECT side, id, {_WORDS.format("text")} AS ws FROM ({rows}) WHERE text IS NOT NULL AND id IS NOT NULL),
    r AS (SELECT DISTINCT side, id, array_to_string(ws, ' ') AS k FROM w WHERE len(ws) > 0),
    d AS (SELECT *, row_number() OVER () AS t FROM (SELECT DISTINCT side IN ({left}) AS a, side IN ({right}) AS b, array_to_string(ws, ' ') AS k, ws FROM w WHERE len(ws) > 0)),
    s AS (SELECT a, b, t, CASE WHEN len(ws) < 5 THEN [k] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM d),
    e AS (SELECT a, b, t, len(sh) AS n, unnest(sh) AS h FROM s),
    p AS (SELECT x.t AS tx, y.t AS ty FROM e x JOIN e y ON x.h = y.h AND x.a AND y.b AND x.n >= {threshold} * y.n AND y.n >= {threshold} * x.n {"AND x.t <= y.t" if left == right else ""}
      GROUP BY x.t, y.t HAVING count(*) >= {threshold} * (any_value(x.n) + any_value(y.n) - count(*))),
    hit AS (SELECT x.k AS ka, y.k AS kb FROM p JOIN d x ON x.t = tx JOIN d y ON y.t = ty)"""


_SPLIT_ROWS = " UNION ALL ".join(f"SELECT '{s}' AS side, complaint_id AS id, narrative AS text FROM split_{s}" for s in ("train", "dev", "test"))
_P1 = _similar_sql(_SPLIT_ROWS, "'train'", "'dev', 'test'", 0.8)
_P1_PAIRS = "FROM hit JOIN r a ON a.k = ka AND a.side = 'train' JOIN r b ON b.k = kb AND b.side <> 'train'"


_VERSIONS = _similar_sql("SELECT 'c' AS side, complaint_id AS id, narrative AS text FROM candidates", "'c'", "'c'", VERSION_SIMILARITY)
_GROUPS = _VERSIONS.replace("WITH w", "WITH RECURSIVE w", 1) + """,
    edge AS (SELECT ka AS a, kb AS b FROM hit WHERE ka <> kb UNION SELECT kb, ka FROM hit WHERE ka <> kb),
    reach AS (SELECT DISTINCT k, k AS m FROM r UNION SELECT reach.k, edge.b FROM reach JOIN edge ON reach.m = edge.a),
    least AS (SELECT reach.k, min(r.id) AS class_id FROM reach JOIN r ON r.k = reach.m GROUP BY 1),
    links AS (SELECT a AS k, count(*) AS n FROM edge GROUP BY 1)
    SELECT r.id AS complaint_id, class_id, coalesce(n, 0)::BIGINT AS n_links FROM r JOIN least USING (k) LEFT JOIN links USING (k)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"{_P1} SELECT DISTINCT b.side AS split, least(a.id, b.id) AS train_id, greatest(a.id, b.id) AS eval_id {_P1_PAIRS}",
        "p2_found": rf"""WITH n AS (SELECT complaint_id, narrative AS t, len({_WORDS.format("narrative")}) AS words FROM candidates WHERE narrative IS NOT NULL),
            c AS (SELECT complaint_id, words, list_transform(regexp_split_to_array(regexp_replace(t, '([.!?]["''”’»)\]}}]*)([ \t]|$)', '\1' || chr(10), 'g'), '[\n\r]'), lambda x: len({_WORDS.format("x")})) AS runs
              FROM n WHERE words > 512)
            SELECT DISTINCT complaint_id, CASE WHEN list_max(runs) > 512 THEN 'forced' ELSE 'natural' END AS cut FROM c""",
        "p5_groups": _GROUPS,
        "p5_found": _VERSIONS
        + " SELECT DISTINCT least(a.id, b.id) AS complaint_id_a, greatest(a.id, b.id) AS complaint_id_b FROM hit JOIN r a ON a.k = ka JOIN r b ON b.k = kb WHERE a.id <> b.id",
    }
