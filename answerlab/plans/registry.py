"""Registered queries over the driver's tables, each with the equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerlab.config import BOOTSTRAPS, CANDIDATE_COLUMNS, LABEL_COUNTS, RAW_COLUMNS, SPLIT_DATES, SPLIT_ROWS, TABULAR_FIELDS
from answerlab.functions import scalar
from answerlab.operators import answer_cache, csvrecords, features, metrics, models, prepare
from answerlab.plans.report import grid_bootstrap, result_rows
from answerlab.session import materialize, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: SQL of the portable hash of a string expression.
_HASH = "('0x' || substr(md5({}), 1, 8))::BIGINT"
_WORDS = "list_filter(regexp_split_to_array(lower({}), '[ \\t\\n\\r\\f]+'), lambda w: w <> '')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _r(c, places: int = 9) -> Column:
    return F.round(c, places)


# ---- records that fail to parse


_CSV = r"""(?:"[^"]*(?:""[^"]*)*"|[^",\r\n]*)"""
#: Raw records by the SQL engine's regular expressions: whether well-formed, the fields unquoted, the first reason to reject.
_RAW = rf"""WITH b AS (SELECT record_id, coalesce(raw, '') AS raw FROM raw_records),
    f AS (SELECT record_id, regexp_full_match(raw, '{_CSV}(?:,{_CSV})*(?:\r\n|\n|\r)?') AS well,
      list_transform(regexp_extract_all(regexp_replace(raw, '(?:\r\n|\n|\r)\z', '') || ',', '({_CSV}),', 1),
        lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) AS c FROM b),
    t AS (SELECT *, trim(c[1]) AS day FROM f),
    d AS (SELECT *, CASE WHEN regexp_full_match(day, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND day >= '0001' THEN try_strptime(day, '%Y-%m-%d')
      WHEN regexp_full_match(day, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') AND day[7:] >= '0001' THEN try_strptime(day, '%m/%d/%Y')
      WHEN regexp_full_match(day, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{2}}') THEN try_strptime(day, '%m/%d/%y') END::DATE AS received FROM t),
    j AS (SELECT *, CASE WHEN NOT well THEN 'quoting' WHEN len(c) <> 18 THEN 'column_count' WHEN NOT regexp_full_match(trim(c[18]), '[0-9]{{8}}') THEN 'complaint_id'
      WHEN received IS NULL THEN 'date_received' WHEN regexp_matches(c[6], '[\x{{FFFD}}\x7F\x00-\x08\x0B\x0C\x0E-\x1F]') THEN 'narrative' END AS reason FROM d)"""


@query(f"{_RAW} SELECT DISTINCT record_id, reason FROM j WHERE reason IS NOT NULL")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    parsed = csvrecords.parse_records(table(spark, d, "raw_records"), "record_id", "raw")
    return csvrecords.rejected_records(parsed, "record_id").distinct()


@query(_RAW + " SELECT record_id, " + ", ".join(f'c[{i}] AS "{c}"' for i, c in enumerate(RAW_COLUMNS, 1)) + " FROM j WHERE reason IS NULL")
def p4_rows(spark: SparkSession, d: str) -> DataFrame:
    return csvrecords.valid_records(csvrecords.parse_records(table(spark, d, "raw_records"), "record_id", "raw"))


# ---- filter, dates, rates, splits

_KEPT = ("Checking or savings account", "Money transfer, virtual currency, or money service")
_ANSWERS = ("Closed with monetary relief", "Closed with non-monetary relief", "Closed with explanation")
_SPAN = f"BETWEEN DATE '{SPLIT_DATES['train'][0]}' AND DATE '{SPLIT_DATES['test'][1]}'"


@query(
    _RAW + " SELECT " + ", ".join(f"{'received' if n == 'date_received' else f'c[{RAW_COLUMNS.index(c) + 1}]'} AS {n}" for c, n in CANDIDATE_COLUMNS.items())
    + f""", (c[15] = '{_ANSWERS[0]}')::INTEGER AS y FROM j WHERE reason IS NULL AND length(trim(c[6], ' ')) > 0 AND c[2] IN {_KEPT} AND c[15] IN {_ANSWERS}
    AND NOT regexp_matches(c[2], '(?i)credit report') AND received {_SPAN}"""
)
def filter_raw_export(spark: SparkSession, d: str) -> DataFrame:
    """The whole filter over the parsed raw records."""
    raw = csvrecords.valid_records(csvrecords.parse_records(table(spark, d, "raw_records"), "record_id", "raw"))
    return prepare.filter_candidates(raw, _KEPT, _ANSWERS, _ANSWERS[0])


@query(
    f"""SELECT complaint_id, product, date_received, y, company FROM candidates
    WHERE narrative IS NOT NULL AND length(trim(narrative, ' ')) > 0 AND product IN ('{_KEPT[0]}', 'Credit card') AND y IS NOT NULL
    AND NOT regexp_matches(product, '(?i)credit report') AND date_received {_SPAN}"""
)
def filter_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates written back as an export, dates in three forms, and filtered by the operator."""
    c = table(spark, d, "candidates")
    turn = F.pmod(F.col("complaint_id").cast("long"), F.lit(3))
    day = F.when(turn == 0, F.date_format("date_received", "yyyy-MM-dd")).when(turn == 1, F.date_format("date_received", "MM/dd/yyyy"))
    answer = F.when(F.col("y") == 1, _ANSWERS[0]).when(F.col("y") == 0, _ANSWERS[2])
    named = [F.col(n).alias(e) for e, n in CANDIDATE_COLUMNS.items() if n != "date_received"]
    raw = c.select(*named, day.otherwise(F.date_format("date_received", "MM/dd/yy")).alias("Date received"), answer.alias("Company response to consumer"))
    out = prepare.filter_candidates(raw, (_KEPT[0], "Credit card"), _ANSWERS, _ANSWERS[0])
    return out.select("complaint_id", "product", "date_received", "y", "company")


@query(
    """SELECT event_id, ts::DATE AS parsed FROM events"""
)
def date_multi_format(spark: SparkSession, d: str) -> DataFrame:
    """Each time written in one of three forms, read back by the three-form parser."""
    e = table(spark, d, "events")
    forms = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "MM/dd/yyyy"))
    return e.select("event_id", scalar.parse_date(forms.otherwise(F.date_format("ts", "M/d/yyyy"))).alias("parsed"))


@query(
    f"""SELECT product, count(*)::BIGINT AS n, round(avg(y), 9) AS rate, coalesce(avg(y) BETWEEN 0.05 AND 0.30, false) AS in_band
    FROM candidates WHERE date_received BETWEEN DATE '{SPLIT_DATES["train"][0]}' AND DATE '{SPLIT_DATES["train"][1]}' GROUP BY product"""
)
def group_rates(spark: SparkSession, d: str) -> DataFrame:
    return prepare.group_rates(table(spark, d, "candidates")).withColumn("rate", _r("rate"))


_SPLIT_CASE = "CASE " + " ".join(f"WHEN date_received BETWEEN DATE '{a}' AND DATE '{b}' THEN '{s}'" for s, (a, b) in SPLIT_DATES.items()) + " END"


def _split_name() -> Column:
    out = None
    for s, (a, b) in SPLIT_DATES.items():
        hit = F.col("date_received").between(F.lit(a).cast("date"), F.lit(b).cast("date"))
        out = F.when(hit, s) if out is None else out.when(hit, s)
    return out


@query(f"SELECT {_SPLIT_CASE} AS split, count(*)::BIGINT AS n, min(date_received) AS first_day, max(date_received) AS last_day FROM candidates GROUP BY 1")
def time_split_counts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates")
    return c.groupBy(_split_name().alias("split")).agg(F.count(F.lit(1)).alias("n"), F.min("date_received").alias("first_day"), F.max("date_received").alias("last_day"))


def _splits(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    parts = [table(spark, d, f"split_{s}").select(F.lit(s).alias("split"), *cols) for s in ("train", "dev", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_SPLITS = "(SELECT 'train' AS split, {0} FROM split_train UNION ALL SELECT 'dev', {0} FROM split_dev UNION ALL SELECT 'test', {0} FROM split_test)"


def _sampled(rows: str, by: str, seed: int, most: str) -> str:
    """SQL of the portable sample of each group."""
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {_HASH.format(f"'{seed}|' || complaint_id")}, complaint_id) AS rn FROM {rows}) WHERE rn <= {most}"


_PLANNED = "CASE split " + " ".join(f"WHEN '{s}' THEN {n}" for s, n in SPLIT_ROWS.items()) + " END"


@query(
    f"""SELECT split, sha256(string_agg(complaint_id, chr(10) ORDER BY complaint_id) || chr(10)) AS sha256, count(complaint_id)::BIGINT AS n
    FROM ({_sampled(_SPLITS.format("complaint_id"), "split", 0, _PLANNED)}) GROUP BY split"""
)
def split_hashes(spark: SparkSession, d: str) -> DataFrame:
    """The hashes of the plan's drawn splits, whose fixed sizes bound the ids of a hash."""
    out = None
    for s, n in SPLIT_ROWS.items():
        part = prepare.portable_sample(table(spark, d, f"split_{s}").select("complaint_id", F.lit(s).alias("split")), n, 0, "complaint_id")
        out = part if out is None else out.unionByName(part)
    return prepare.id_hash(out, "complaint_id", ["split"])


@query("SELECT complaint_id, count(*)::BIGINT AS n FROM candidates GROUP BY complaint_id HAVING count(*) > 1")
def repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    return prepare.repeated_ids(table(spark, d, "candidates"), "complaint_id")


@query(f"SELECT complaint_id, split FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {_HASH.format("'7|' || complaint_id")}, complaint_id) AS rn FROM {_SPLITS.format('complaint_id')}) WHERE rn <= 200")
def portable_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: the limit is the feature."""
    out = None
    for s in ("train", "dev", "test"):
        part = prepare.portable_sample(table(spark, d, f"split_{s}").select("complaint_id", F.lit(s).alias("split")), 200, 7, "complaint_id")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    f"""WITH p AS (SELECT complaint_id, y, row_number() OVER (PARTITION BY y ORDER BY {_HASH.format("'3|' || complaint_id")}, complaint_id) AS rn,
    count(*) OVER () AS n, sum(y) OVER () AS pos FROM split_train WHERE y IS NOT NULL),
    k AS (SELECT *, greatest(least(greatest(round_even(50 * pos / n, 0), 1), pos, 49), 50 - (n - pos)) AS take FROM p)
    SELECT complaint_id, y FROM k WHERE (y = 1 AND rn <= take) OR (y = 0 AND rn <= 50 - take)"""
)
def stratified_draw(spark: SparkSession, d: str) -> DataFrame:
    return prepare.stratified_draw(table(spark, d, "split_train").select("complaint_id", "y"), 50, 3, "complaint_id")


@query(
    f"""SELECT complaint_id, y, ((row_number() OVER (PARTITION BY y ORDER BY {_HASH.format("'fold|' || complaint_id")}, complaint_id) - 1) % 5)::INTEGER AS fold
    FROM ({_sampled("(SELECT complaint_id, y, 1 AS one FROM split_train WHERE y IS NOT NULL)", "one", 0, str(SPLIT_ROWS["train"]))})"""
)
def fold_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Folds of the plan's drawn training sample."""
    rows = table(spark, d, "split_train").where("y is not null").select("complaint_id", "y")
    return prepare.folds(prepare.portable_sample(rows, SPLIT_ROWS["train"], 0, "complaint_id"), 5, "complaint_id")


# ---- texts


@query(
    f"""WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, len(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END))::INTEGER AS n_shingles FROM w"""
)
def shingle_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.size(scalar.shingles(F.col("text"), 5, unicode_space=False)).alias("n_shingles"))


_NEAR = f"""WITH t AS (SELECT 0 AS side, narrative AS text FROM split_test UNION SELECT 1, narrative FROM split_train UNION SELECT 1, narrative FROM split_dev),
    w AS (SELECT side, text, {_WORDS.format("text")} AS ws FROM t WHERE text IS NOT NULL),
    s AS (SELECT side, text, CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE
      list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w WHERE len(ws) > 0),
    e AS (SELECT side, text, len(sh) AS n, unnest(sh) AS h FROM s),
    j AS (SELECT a.text AS ta, b.text AS tb, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM e a JOIN e b ON a.h = b.h AND a.side = 0 AND b.side = 1 GROUP BY 1, 2),
    hit AS (SELECT ta, tb, k / (na + nb - k) AS sim FROM j WHERE k / (na + nb - k) >= 0.8)"""


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    name = lambda t: table(spark, d, t).select(F.col("complaint_id").alias("id"), F.col("narrative").alias("text"))
    return name("split_test"), name("split_train").unionByName(name("split_dev"))


@query(_NEAR + " SELECT sha256(ta) AS test_text, sha256(tb) AS reference_text, round(sim, 9) AS similarity FROM hit")
def neardup_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs between distinct texts; copies are not expanded."""
    test, reference = _sides(spark, d)
    pairs = prepare.near_pairs(test, reference)
    left = test.where("text is not null").select(F.xxhash64("text").alias("left_key"), F.sha2("text", 256).alias("test_text")).distinct()
    right = reference.where("text is not null").select(F.xxhash64("text").alias("right_key"), F.sha2("text", 256).alias("reference_text")).distinct()
    return pairs.join(left, "left_key").join(right, "right_key").select("test_text", "reference_text", _r("similarity").alias("similarity"))


@query(_NEAR + " SELECT complaint_id FROM split_test WHERE narrative IS NULL OR narrative NOT IN (SELECT ta FROM hit)")
def neardup_drop(spark: SparkSession, d: str) -> DataFrame:
    reference = table(spark, d, "split_train").select("complaint_id", "narrative").unionByName(table(spark, d, "split_dev").select("complaint_id", "narrative"))
    return prepare.drop_near_duplicates(table(spark, d, "split_test"), reference, "complaint_id", "narrative").select("complaint_id")


@query("SELECT sha256(narrative) AS text_sha256, min(complaint_id) AS complaint_id FROM candidates WHERE narrative IS NOT NULL GROUP BY 1")
def text_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return answer_cache.first_per_text(table(spark, d, "candidates"), "complaint_id", "narrative").select("text_sha256", "complaint_id")


@query("SELECT doc_id, length(text)::INTEGER AS n_chars FROM documents ORDER BY length(text) DESC, doc_id LIMIT 20")
def longest_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return prepare.longest(docs, "text", "doc_id", 20).select("doc_id", F.length("text").alias("n_chars"))


@query(
    f"""WITH w AS (SELECT doc_id, len({_WORDS.format("text")}) AS n FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, n, unnest(range(0, 1 + greatest(0, ceil((n - 489) / 425.0))::BIGINT)) AS k FROM w)
    SELECT doc_id, k::INTEGER AS chunk, (k * 425)::INTEGER AS first_word, least(n - k * 425, 489)::INTEGER AS n_words FROM c"""
)
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows over words beside a hypothesis of 20 tokens."""
    docs = table(spark, d, "documents").where("text is not null")
    ws = scalar.words(F.col("text"), unicode_space=False)
    out = docs.select("doc_id", F.posexplode(scalar.chunks(ws, hypothesis=20)).alias("chunk", "part"))
    return out.select("doc_id", "chunk", (F.col("chunk") * 425).alias("first_word"), F.size("part").alias("n_words"))


@query(
    f"""WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, ws, unnest(range(0, 1 + greatest(0, ceil((len(ws) - 489) / 425.0))::BIGINT)) AS k FROM w),
    s AS (SELECT doc_id, h, len(list_filter(ws[k*425+1:k*425+489], lambda x: x = h)) / 100.0 AS score FROM c, (SELECT unnest(['bank', 'card', 'fee']) AS h))
    SELECT doc_id, h AS hypothesis, round(max(score), 9) AS score, count(*)::BIGINT AS chunks FROM s GROUP BY 1, 2"""
)
def chunk_max_pool(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    parts = docs.select("doc_id", F.explode(scalar.chunks(scalar.words(F.col("text"), unicode_space=False), hypothesis=20)).alias("part"))
    hyps = F.explode(F.array(*map(F.lit, ("bank", "card", "fee")))).alias("hypothesis")
    scored = parts.select("doc_id", "part", hyps).withColumn("score", F.size(F.expr("filter(part, x -> x = hypothesis)")) / 100.0)
    return features.max_pool(scored, ["doc_id", "hypothesis"], "score").withColumn("score", _r("score"))


@query(
    r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
    per AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1 HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 20000),
    w AS (SELECT doc_id AS id, tf.term, tf * (ln((1 + (SELECT count(*) FROM documents WHERE text IS NOT NULL)) / (1 + df)) + 1) AS w FROM tf JOIN per USING (term))
    SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM w"""
)
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    return models.tfidf_weights(table(spark, d, "documents"), "doc_id", "text").withColumn("weight", _r("weight", 6))


# ---- the answer cache


def _cache(spark: SparkSession, d: str, split: str, payload: str) -> DataFrame:
    """A split's texts as answered rows."""
    rows = answer_cache.first_per_text(table(spark, d, f"split_{split}"), "complaint_id", "narrative")
    return rows.select(
        F.lit("hosted").alias("answerer"), F.lit("m1").alias("model_version"), F.lit("q1").alias("question_set_hash"), "text_sha256", "complaint_id", F.lit(payload).alias("payload")
    )


_CACHE = "SELECT sha256(narrative) AS text_sha256, min(complaint_id) AS complaint_id, '{1}' AS payload FROM split_{0} WHERE narrative IS NOT NULL GROUP BY 1"
_SHOWN = ["text_sha256", "complaint_id", "payload"]


@query(f"WITH c AS ({_CACHE.format('train', 'a')}) SELECT sha256(narrative) AS text_sha256, min(complaint_id) AS complaint_id FROM candidates WHERE narrative IS NOT NULL AND sha256(narrative) NOT IN (SELECT text_sha256 FROM c) GROUP BY 1")
def cache_todo(spark: SparkSession, d: str) -> DataFrame:
    return answer_cache.todo(table(spark, d, "candidates"), _cache(spark, d, "train", "a"), "hosted", "m1", "q1").select("text_sha256", "complaint_id")


@query(f"WITH a AS ({_CACHE.format('train', 'a')}), b AS ({_CACHE.format('test', 'b')}) SELECT * FROM a WHERE text_sha256 NOT IN (SELECT text_sha256 FROM b) UNION ALL SELECT * FROM b")
def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    return answer_cache.upsert(_cache(spark, d, "train", "a"), _cache(spark, d, "test", "b")).select(*_SHOWN)


@query(f"WITH a AS ({_CACHE.format('train', 'a')}), b AS ({_CACHE.format('test', 'b')}) SELECT * FROM a UNION ALL SELECT * FROM b WHERE text_sha256 NOT IN (SELECT text_sha256 FROM a)")
def cache_merge(spark: SparkSession, d: str) -> DataFrame:
    return answer_cache.merge(_cache(spark, d, "train", "a"), _cache(spark, d, "test", "b")).select(*_SHOWN)


@query(
    f"""WITH c AS ({_CACHE.format('train', 'a')}) SELECT s.split, s.complaint_id, c.payload, CASE WHEN c.text_sha256 IS NULL THEN 'missing' END AS error
    FROM {_SPLITS.format('complaint_id, narrative')} s LEFT JOIN c ON sha256(s.narrative) = c.text_sha256"""
)
def answers_export(spark: SparkSession, d: str) -> DataFrame:
    from answerlab.operators.answerers import export_hosted

    cache = _cache(spark, d, "train", "a").withColumn("error", F.lit(None).cast("string")).withColumn("input_tokens", F.lit(None).cast("long"))
    rows = _splits(spark, d, "complaint_id", "narrative").withColumn("row", F.struct("split", "complaint_id"))
    return export_hosted(rows, cache, "row").select("row.*", "payload", "error")


@query("SELECT event_type, count(*)::BIGINT AS n, count(json_extract(props, '$'))::BIGINT AS parsed, round(avg(value), 9) AS mean_value FROM events GROUP BY 1")
def payload_parse(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("parsed", F.from_json("props", "map<string,string>"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("parsed").alias("parsed"), _r(F.avg("value")).alias("mean_value"))


# ---- features


@query(
    """SELECT vec_id, round((e2 + 2 * e3 + 3 * e4) / (e1 + e2 + e3 + e4), 6) AS level FROM
    (SELECT vec_id, exp(embedding[1]::DOUBLE) AS e1, exp(embedding[2]::DOUBLE) AS e2, exp(embedding[3]::DOUBLE) AS e3, exp(embedding[4]::DOUBLE) AS e4 FROM embeddings)"""
)
def softmax_expected_level(spark: SparkSession, d: str) -> DataFrame:
    logits = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", _r(scalar.level_from_logits(logits), 6).alias("level"))


@query("SELECT l_orderkey, l_linenumber, round(1 * l_discount + 2 * l_tax, 9) AS level FROM lineitem")
def expected_level_map(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("0"), 1 - F.col("l_discount") - F.col("l_tax"), F.lit("1"), F.col("l_discount"), F.lit("2"), F.col("l_tax"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _r(scalar.expected_level(m)).alias("level"))


@query("SELECT label, i::INTEGER AS i, round(avg(v::DOUBLE), 6) AS mean FROM (SELECT label, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS v FROM embeddings) GROUP BY 1, 2")
def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    pooled = features.mean_pool(table(spark, d, "embeddings"), ["label"], "embedding")
    return pooled.select("label", F.posexplode("embedding").alias("i", "mean")).withColumn("mean", _r("mean", 6))


_VALUES = " UNION ALL ".join(f"SELECT '{f}' AS field, coalesce({f}, '') AS value FROM split_train" for f in TABULAR_FIELDS[1:])
_TOP = "SELECT coalesce(company, '') AS value, count(*) AS n FROM split_train GROUP BY 1 ORDER BY n DESC, value LIMIT 50"
_VOCAB = f"""SELECT field, value, (row_number() OVER (PARTITION BY field ORDER BY value) - 1)::INTEGER AS code FROM (
    SELECT DISTINCT field, value FROM ({_VALUES} UNION ALL SELECT 'company', value FROM ({_TOP})
    UNION ALL SELECT unnest({list(TABULAR_FIELDS)}), 'other'))"""


@query(_TOP.replace("count(*) AS n", "count(*)::BIGINT AS n"))
def company_top_k(spark: SparkSession, d: str) -> DataFrame:
    return features.top_values(table(spark, d, "split_train"), "company")


@query(_VOCAB)
def vocab_codes(spark: SparkSession, d: str) -> DataFrame:
    return features.fit_vocabulary(table(spark, d, "split_train"))


@query(f"SELECT field, max(code)::INTEGER AS max_code FROM ({_VOCAB}) GROUP BY field")
def vocab_max_codes(spark: SparkSession, d: str) -> DataFrame:
    return features.max_codes(features.fit_vocabulary(table(spark, d, "split_train")))


@query(
    f"WITH v AS ({_VOCAB}) SELECT s.complaint_id, month(s.date_received)::INTEGER AS month, "
    + ", ".join(f"coalesce((SELECT code FROM v WHERE field = '{f}' AND value = coalesce(s.{f}, '')), (SELECT code FROM v WHERE field = '{f}' AND value = 'other')) AS {f}_code" for f in TABULAR_FIELDS)
    + " FROM split_test s"
)
def tabular_codes(spark: SparkSession, d: str) -> DataFrame:
    coded = features.encode(table(spark, d, "split_test"), features.fit_vocabulary(table(spark, d, "split_train")))
    return coded.select("complaint_id", "month", *(f"{f}_code" for f in TABULAR_FIELDS))


@query(
    f"""SELECT answerer, split, sum((NOT ok)::INTEGER)::BIGINT AS failed, count(*)::BIGINT AS total FROM (
    SELECT split, 'text' AS answerer, coalesce(length(trim(narrative)) > 0, false) AS ok FROM {_SPLITS.format('narrative, sub_issue')}
    UNION ALL SELECT split, 'sub_issue', sub_issue IS NOT NULL FROM {_SPLITS.format('narrative, sub_issue')}) GROUP BY 1, 2"""
)
def failure_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _splits(spark, d, "narrative", "sub_issue")
    rows = rows.select("split", (F.length(F.trim("narrative")) > 0).alias("text_ok"), F.col("sub_issue").isNotNull().alias("sub_ok"))
    return features.failures(rows, {"text": "text_ok", "sub_issue": "sub_ok"})


@query(f"SELECT split, count(*)::BIGINT AS kept FROM {_SPLITS.format('narrative, sub_issue, tags')} WHERE coalesce(length(trim(narrative)) > 0, false) AND sub_issue IS NOT NULL AND tags IS NOT NULL GROUP BY split")
def shared_mask_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _splits(spark, d, "narrative", "sub_issue", "tags")
    mask = features.shared_mask(F.length(F.trim("narrative")) > 0, F.col("sub_issue").isNotNull(), F.col("tags").isNotNull())
    return rows.where(mask).groupBy("split").agg(F.count(F.lit(1)).alias("kept"))


@query(
    """SELECT i::INTEGER AS i, count(v)::BIGINT AS n, round(avg(v::DOUBLE), 6) AS mean, round(stddev_pop(v::DOUBLE), 6) AS std,
    count(v) = 0 OR stddev_pop(v::DOUBLE) < 0.01 AS broken FROM (SELECT unnest(range(0, len(embedding))) AS i, unnest(embedding) AS v FROM embeddings) GROUP BY 1"""
)
def dev_spread(spark: SparkSession, d: str) -> DataFrame:
    long = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    return features.spread_report(long, ["i"], "v").withColumn("mean", _r("mean", 6)).withColumn("std", _r("std", 6))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding) AS ok FROM embeddings")
def finite_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", scalar.all_finite(F.col("embedding")).alias("ok"))


@query("SELECT round(10000.0 * avg(n_chars) * 0.5 / 1e6, 9) AS cost FROM documents")
def cost_per_10k(spark: SparkSession, d: str) -> DataFrame:
    """The price is this query's own parameter."""
    return table(spark, d, "documents").agg(F.avg("n_chars").alias("m")).select(_r(scalar.cost_per_10k(F.col("m"), 0.5)).alias("cost"))


# ---- metrics and statistics; scores are made of the text's length, with many ties

_SCORED = "SELECT t.complaint_id, t.date_received, l.y, (coalesce(length(narrative), 0) % 97) / 97.0 AS score, (coalesce(length(narrative), 0) % 101) / 101.0 AS score2 FROM split_test t JOIN test_labels l USING (complaint_id) WHERE l.y IS NOT NULL"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    n = F.coalesce(F.length("narrative"), F.lit(0))
    rows = table(spark, d, "split_test").join(table(spark, d, "test_labels"), "complaint_id").where("y is not null")
    return rows.select("complaint_id", "date_received", "y", ((n % 97) / 97.0).alias("score"), ((n % 101) / 101.0).alias("score2"))


def _ap(rows: str, by: str = "", weight: str = "1.0", score: str = "score") -> str:
    """SQL of average precision per group over a row source."""
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT {g}CASE WHEN sum(tp) = 0 OR sum(tp) = sum(n) THEN 'nan'::DOUBLE ELSE sum(tp * ctp / cn) / sum(tp) END AS pr_auc FROM (
    SELECT {g}tp, n, sum(tp) OVER ({part}ORDER BY s DESC) AS ctp, sum(n) OVER ({part}ORDER BY s DESC) AS cn FROM (
    SELECT {g}{score} AS s, sum({weight} * y)::DOUBLE AS tp, sum({weight})::DOUBLE AS n FROM {rows} GROUP BY {g}{score})){f" GROUP BY {by}" if by else ""}"""


@query(f"SELECT round(pr_auc, 9) AS pr_auc FROM ({_ap(f'({_SCORED})')})")
def pr_auc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.average_precision(_scored(spark, d), []).withColumn("pr_auc", _r("pr_auc"))


@query(
    f"""WITH p AS (SELECT score AS s, sum(y)::DOUBLE AS tp, sum(1 - y)::DOUBLE AS fp FROM ({_SCORED}) GROUP BY 1),
    c AS (SELECT tp, fp, sum(tp) OVER (ORDER BY s DESC) AS ctp FROM p) SELECT round(sum(fp * (ctp - tp / 2)) / (sum(tp) * sum(fp)), 9) AS roc_auc FROM c"""
)
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.roc_auc(_scored(spark, d), []).withColumn("roc_auc", _r("roc_auc"))


@query(f"SELECT half_year, round(pr_auc, 9) AS pr_auc FROM ({_ap(f'(SELECT *, year(date_received) || (CASE WHEN month(date_received) <= 6 THEN {chr(39)}H1{chr(39)} ELSE {chr(39)}H2{chr(39)} END) AS half_year FROM ({_SCORED}))', 'half_year')})")
def half_year_pr_auc(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).withColumn("half_year", scalar.half_year(F.col("date_received")))
    return metrics.average_precision(rows, ["half_year"]).withColumn("pr_auc", _r("pr_auc"))


_SEEDS = f"(SELECT complaint_id, y, seed, (coalesce(length(complaint_id), 0) + {_HASH.format("seed || '|' || complaint_id")} % 50) / 58.0 AS score FROM ({_SCORED}), (SELECT unnest(range(0, 5)) AS seed))"


@query(f"SELECT round(avg(pr_auc), 9) AS pr_auc FROM ({_ap(_SEEDS, 'seed')})")
def seed_mean(spark: SparkSession, d: str) -> DataFrame:
    seeds = _scored(spark, d).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(4))))
    h = scalar.portable_hash(F.concat_ws("|", F.col("seed").cast("string"), "complaint_id"))
    rows = seeds.withColumn("score", (F.length("complaint_id") + h % 50) / 58.0)
    return metrics.seed_mean(metrics.average_precision(rows, ["seed"]), [], "pr_auc").withColumn("pr_auc", _r("pr_auc"))


_TAKEN = f"(SELECT *, row_number() OVER (ORDER BY {_HASH.format("'0|' || complaint_id")}, complaint_id) - 1 AS row_no FROM ({_SCORED}))"
_NUMBERED = f"(SELECT * FROM {_TAKEN} WHERE row_no < {SPLIT_ROWS['test']})"
_DRAWS = f"""(SELECT boot, {_HASH.format("'boot-' || boot || '-' || i")} % n AS row_no, count(*) AS w FROM (SELECT unnest(range(0, {BOOTSTRAPS})) AS boot),
    (SELECT count(*) AS n, unnest(range(0, count(*))) AS i FROM {_NUMBERED}) GROUP BY 1, 2)"""


def _boots(spark: SparkSession, d: str, *scores: str) -> list[DataFrame]:
    """The plan's resamples of its drawn test sample, the same for all scores."""
    sample = prepare.portable_sample(_scored(spark, d), SPLIT_ROWS["test"], 0, "complaint_id")
    order = Window.orderBy(scalar.portable_hash(F.concat_ws("|", F.lit("0"), "complaint_id")), "complaint_id")  # a drawn sample: bounded
    rows = materialize(sample.withColumn("row_no", (F.row_number().over(order) - 1).cast("long")))
    draws = materialize(metrics.resamples(rows.count(), BOOTSTRAPS, spark))
    return [metrics.bootstrap(rows.select("row_no", F.col(s).alias("score"), "y"), draws, []) for s in scores]


def _boot_sql(score: str) -> str:
    return _ap(f"(SELECT boot, w, y, {score} FROM {_DRAWS} JOIN {_NUMBERED} USING (row_no))", "boot", "w", score)


@query(f"SELECT round(avg(pr_auc), 6) AS mean, round(quantile_cont(pr_auc, 0.025), 6) AS lo, round(quantile_cont(pr_auc, 0.975), 6) AS hi FROM ({_boot_sql('score')})")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.ci95(_boots(spark, d, "score")[0], [], "pr_auc")
    return out.select(*(_r(c, 6).alias(c) for c in ("mean", "lo", "hi")))


@query(
    f"""WITH a AS ({_boot_sql('score')}), b AS ({_boot_sql('score2')}), d AS (SELECT a.pr_auc - b.pr_auc AS x FROM a JOIN b USING (boot)),
    c AS (SELECT avg(x) AS mean, quantile_cont(x, 0.025) AS lo, quantile_cont(x, 0.975) AS hi FROM d)
    SELECT round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, CASE WHEN lo > 0 THEN 'first better' WHEN hi < 0 THEN 'second better'
    WHEN lo >= -0.02 AND hi <= 0.02 THEN 'equivalent' ELSE 'inconclusive' END AS verdict FROM c"""
)
def paired_delta(spark: SparkSession, d: str) -> DataFrame:
    delta = metrics.paired_delta(*_boots(spark, d, "score", "score2"), [])
    out = metrics.ci95(delta, [], "delta")
    return out.select(*(_r(c, 6).alias(c) for c in ("mean", "lo", "hi")), metrics.verdict(F.col("lo"), F.col("hi"), 0.02).alias("verdict"))


@query(
    """WITH l AS (SELECT month(o_orderdate) AS n_labels, avg(o_totalprice) - (SELECT avg(o_totalprice) FROM orders) AS lo FROM orders GROUP BY 1),
    w AS (SELECT min(n_labels) AS first_win FROM l WHERE lo > 0), s AS (SELECT min(n_labels) AS stops_at FROM l, w WHERE n_labels > first_win AND lo <= 0)
    SELECT CASE WHEN first_win IS NULL THEN 'never beats' WHEN stops_at IS NULL THEN 'keeps beating' ELSE 'stops' END AS status, stops_at::INTEGER AS stops_at FROM w, s"""
)
def stops_beating(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    mean = orders.agg(F.avg("o_totalprice").alias("m"))
    per = orders.groupBy(F.month("o_orderdate").alias("n_labels")).agg(F.avg("o_totalprice").alias("a"))
    return metrics.stops_beating(per.join(F.broadcast(mean)).select("n_labels", (F.col("a") - F.col("m")).alias("lo")))  # mean is one row


@query(f"WITH b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, avg(y) AS my, avg(score) AS mp FROM ({_SCORED}) GROUP BY 1) SELECT round(sum(abs(my - mp) * n) / sum(n), 9) AS ece FROM b")
def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    return metrics.calibration_error(_scored(spark, d).withColumnRenamed("score", "p")).withColumn("ece", _r("ece"))


@query(f"SELECT product, round(avg((((coalesce(length(narrative), 0) % 97) / 97.0 >= 0.5)::INTEGER = y)::INTEGER), 9) AS accuracy FROM split_dev WHERE y IS NOT NULL GROUP BY product")
def accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "split_dev").where("y is not null").withColumn("p", (F.coalesce(F.length("narrative"), F.lit(0)) % 97) / 97.0)
    return metrics.accuracy(rows, ["product"]).withColumn("accuracy", _r("accuracy"))


# ---- models


def _built(spark: SparkSession, d: str, sizes: dict[str, int] = SPLIT_ROWS) -> DataFrame:
    """Drawn splits, of the plan's sizes unless told otherwise, with tabular codes and two vectors of word counts as answers."""
    vocabulary = features.fit_vocabulary(table(spark, d, "split_train"))
    labels = table(spark, d, "test_labels")
    out = None
    for s, most in sizes.items():
        rows = table(spark, d, f"split_{s}")
        rows = rows if s != "test" else rows.join(labels, "complaint_id")
        rows = prepare.portable_sample(rows.where("y is not null and narrative is not null"), most, 0, "complaint_id").withColumn("split", F.lit(s))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    coded = features.tabular_vectors(out, vocabulary)
    answers = lambda ws: F.array(*((F.size(F.split(F.lower("narrative"), w)) - 1).cast("double") for w in ws))
    return coded.select(
        "split", "complaint_id", "y", F.col("narrative").alias("text"), "tab",
        answers(("fee", "refund", "check", "letter")).alias("local"), answers(("called", "branch", "report", "credit")).alias("hosted"),
    )


@query()
def arm_grid(spark: SparkSession, d: str) -> DataFrame:
    """Test scores of the arms whose features these tables have; label draws and samples are the plan's sampling operators."""
    return models.run_grid(_built(spark, d), models.ARMS, LABEL_COUNTS, ("tab", "local", "hosted"))


@query()
def arm_results(spark: SparkSession, d: str) -> DataFrame:
    scores = materialize(arm_grid(spark, d))  # read three times
    rows = result_rows(scores, grid_bootstrap(scores, BOOTSTRAPS))
    return spark.createDataFrame(rows, "arm_id int, arm string, n_labels int, labels_drawn int, seeds int, pr_auc double, pr_auc_lo double, pr_auc_hi double, roc_auc double, lift double, lift_lo double, lift_hi double, chart boolean")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


assert LABEL_COUNTS[0] < LABEL_COUNTS[1]
