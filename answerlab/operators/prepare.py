"""From the raw export to frozen splits: filter, group rates, time split, near-duplicate removal, samples, hashes."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerlab.config import CANDIDATE_COLUMNS, NEARDUP_SIMILARITY, RATE_BAND, SHINGLE_WORDS, SPLIT_DATES
from answerlab.functions.scalar import parse_date, portable_hash, shingle_hashes
from answerlab.session import materialize
from answerlab.sources.tables import write_json, write_parquet, write_sheet


def not_blank(text: Column) -> Column:
    """Neither null nor only blanks; tabs and line breaks count as signs here."""
    return text.isNotNull() & (F.length(F.trim(text)) > 0)


def filter_candidates(
    raw: DataFrame,
    products: tuple[str, ...],
    responses: tuple[str, ...],
    positive: str,
    first: str = SPLIT_DATES["train"][0],
    last: str = SPLIT_DATES["test"][1],
    excluded: str = "(?i)credit report",
    strict_dates: bool = False,
) -> DataFrame:
    """The filtered records with the columns of the candidates table and the label ``y``.

    Kept are rows with a narrative, a known product that does not match ``excluded``, one of ``responses`` and a date
    inside the range.  ``strict_dates`` reads no two-digit years.  Null products, responses and dates drop the row.
    """
    when = parse_date(F.col("Date received"), two_digit_years=not strict_dates)
    response = F.col("Company response to consumer")
    named = [when.alias(n) if n == "date_received" else F.col(f"`{c}`").alias(n) for c, n in CANDIDATE_COLUMNS.items()]
    return raw.where(
        not_blank(F.col("Consumer complaint narrative"))
        & response.isin(*responses)
        & F.col("Product").isin(*products)
        & ~F.col("Product").rlike(excluded)
        & when.between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    ).select(*named, (response == positive).cast("int").alias("y"))


def in_dates(df: DataFrame, split: str, column: str = "date_received") -> DataFrame:
    """Rows of a split's date range, both days included."""
    a, b = SPLIT_DATES[split]
    return df.where(F.col(column).between(F.lit(a).cast("date"), F.lit(b).cast("date")))


def group_rates(candidates: DataFrame, key: str = "product", y: str = "y") -> DataFrame:
    """Rows and label rate per group over the training dates, commonest first, and whether the rate is in the band."""
    lo, hi = RATE_BAND
    return (
        in_dates(candidates, "train")
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("rate"))
        .withColumn("in_band", F.coalesce(F.col("rate").between(lo, hi), F.lit(False)))
        .orderBy(F.desc("n"), key)
    )


def near_pairs(left: DataFrame, right: DataFrame, threshold: float = NEARDUP_SIMILARITY, n: int = SHINGLE_WORDS) -> DataFrame:
    """Exact similarity join of ``(id, text)`` tables: ``(left_key, right_key, similarity)`` between distinct texts.

    Keys are hashes of the text; join the ids back by :func:`text_keys`.  A pair at the threshold shares one of each
    side's rarest shingles (prefix filter), so only those are joined: boilerplate that most texts hold is
    joined only by texts that hold little else.  Texts without words take no part.
    """
    def sets(df: DataFrame, side: int) -> DataFrame:
        keyed = df.where("text is not null").select(F.xxhash64("text").alias("key"), "text").dropDuplicates(["key"])
        return keyed.select("key", F.lit(side).alias("side"), shingle_hashes(F.col("text"), n).alias("s")).where(F.size("s") > 0)

    both = materialize(sets(left, 0).unionByName(sets(right, 1)))
    rows = both.select("key", "side", F.size("s").alias("size"), F.explode("s").alias("h"))
    spread = rows.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("side").alias("a"), F.max("side").alias("b"))
    shared = spread.where("a = 0 and b = 1").select("h", "df")  # a shingle of one side alone joins nothing
    rank = F.row_number().over(Window.partitionBy("side", "key").orderBy(F.coalesce("df", F.lit(1)), "h"))
    prefix = rows.join(shared, "h", "left").withColumn("rank", rank).where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * threshold) + 1)
    prefix = prefix.where("df is not null")
    a = prefix.where("side = 0").select(F.col("key").alias("left_key"), "h", F.col("size").alias("na"))
    b = prefix.where("side = 1").select(F.col("key").alias("right_key"), "h", F.col("size").alias("nb"))
    near_size = (F.col("na") >= F.col("nb") * threshold) & (F.col("nb") >= F.col("na") * threshold)
    pairs = a.join(b, "h").where(near_size).select("left_key", "right_key").distinct()
    sa = both.where("side = 0").select(F.col("key").alias("left_key"), F.col("s").alias("sa"))
    sb = both.where("side = 1").select(F.col("key").alias("right_key"), F.col("s").alias("sb"))
    both_n = F.size(F.array_intersect("sa", "sb"))
    sim = both_n / (F.size("sa") + F.size("sb") - both_n)
    return pairs.join(sa, "left_key").join(sb, "right_key").select("left_key", "right_key", sim.alias("similarity")).where(F.col("similarity") >= threshold)


def text_keys(df: DataFrame) -> DataFrame:
    """``(id, key)`` of ``(id, text)`` rows, keys as :func:`near_pairs` has them."""
    return df.where("text is not null").select("id", F.xxhash64("text").alias("key"))


def drop_near_duplicates(test: DataFrame, reference: DataFrame, id_col: str, text_col: str, threshold: float = NEARDUP_SIMILARITY) -> DataFrame:
    """Rows of ``test`` whose text is not nearly one of ``reference``; rows without words stay."""
    mine = test.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    other = reference.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hit = near_pairs(mine, other, threshold).select(F.col("left_key").alias("_key")).distinct()
    return test.withColumn("_key", F.xxhash64(text_col)).join(hit, "_key", "left_anti").drop("_key")


def portable_sample(df: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """``n`` rows without replacement, by the hash of seed and id; all rows of a smaller table."""
    return df.orderBy(portable_hash(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"))), id_col).limit(n)


def id_hash(df: DataFrame, id_col: str, by: list[str] | None = None) -> DataFrame:
    """sha256 over the sorted ids, each followed by a line feed, and the number of ids.

    Only for bounded tables such as drawn splits: the ids of a group are joined into one string.
    """
    line = F.concat(F.array_join(F.array_sort(F.collect_list(F.col(id_col).cast("string"))), "\n"), F.when(F.count(id_col) > 0, "\n").otherwise(""))
    return df.groupBy(*(by or [])).agg(F.sha2(line, 256).alias("sha256"), F.count(id_col).alias("n"))


def repeated_ids(df: DataFrame, id_col: str, by: list[str] | None = None) -> DataFrame:
    """Ids that occur more than once (inside each group of ``by``) and how often."""
    return df.groupBy(*(by or []), id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def split_by_time(candidates: DataFrame, sizes: dict[str, int] | None, seed: int = 0) -> dict[str, DataFrame]:
    """Train, dev and test rows: date ranges, near-duplicates dropped from the whole test range, then samples, or all rows without ``sizes``.

    Raises ValueError where an id stands twice in a split or in two splits.
    """
    train, dev = in_dates(candidates, "train"), in_dates(candidates, "dev")
    test = drop_near_duplicates(in_dates(candidates, "test"), train.unionByName(dev), "complaint_id", "narrative")
    out = {k: materialize(portable_sample(df, sizes[k], seed, "complaint_id") if sizes else df) for k, df in (("train", train), ("dev", dev), ("test", test))}
    every = None
    for name, df in out.items():
        part = df.select("complaint_id", F.lit(name).alias("split"))
        every = part if every is None else every.unionByName(part)
    if not repeated_ids(every, "complaint_id", ["split"]).isEmpty():
        raise ValueError("an id stands twice in a split")
    if not repeated_ids(every, "complaint_id").isEmpty():
        raise ValueError("an id stands in two splits")
    return out


def write_splits(splits: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Write the splits; test labels go to a table of their own, and the id hashes to a JSON file."""
    for name, df in splits.items():
        write_parquet(df.drop("y") if name == "test" else df, f"{folder}/{name}.parquet")
    write_parquet(splits["test"].select("complaint_id", "y"), f"{folder}/test_labels.parquet")
    hashes = {name: id_hash(df, "complaint_id").first()["sha256"] for name, df in splits.items()}
    write_json(hashes, Path(folder) / "splits.json")
    return hashes


def positives_wanted(n: int, pos: int, neg: int) -> int:
    """Positives of a draw of ``n`` rows from a pool of ``pos`` and ``neg``."""
    share = round(n * pos / (pos + neg)) if pos + neg else 0
    most = min(pos, n - 1 if neg else n)  # one place is kept for a negative
    return max(min(max(share, 1), most), n - neg, 0)


def stratified_draw(df: DataFrame, n: int, seed: int, id_col: str, y: str = "y") -> DataFrame:
    """``n`` labelled rows that keep the label rate: at least one of each class if there are any and ``n`` allows, a negative first.

    Raises ValueError if there are fewer labelled rows than ``n``.
    """
    pool = df.where(F.col(y).isNotNull())
    count = {r[y]: r["n"] for r in pool.groupBy(y).agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = count.get(1, 0), count.get(0, 0)
    if n > pos + neg:
        raise ValueError(f"{n} rows asked of a pool of {pos + neg}")
    want = positives_wanted(n, pos, neg)
    order = portable_hash(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))
    parts = [pool.where(F.col(y) == v).orderBy(order, id_col).limit(k) for v, k in ((1, want), (0, n - want))]
    return parts[0].unionByName(parts[1])


def folds(df: DataFrame, k: int, id_col: str, y: str = "y") -> DataFrame:
    """``df`` with a ``fold``: rows of each class dealt round in hashed order, so that folds keep the label rate.

    For drawn label sets: the rows of a class are numbered in one task.
    """
    order = portable_hash(F.concat_ws("|", F.lit("fold"), F.col(id_col).cast("string")))
    return df.withColumn("fold", ((F.row_number().over(Window.partitionBy(y).orderBy(order, id_col)) - 1) % k).cast("int"))


def hand_label_sheet(test: DataFrame, questions: list[tuple[str, str]], path: str | Path, rows: int = 100, per: int = 5, seed: int = 20_240_701, id_col: str = "complaint_id", text_col: str = "narrative") -> Path:
    """A sheet of ``rows`` test rows times ``per`` yes/no questions ``(id, text)`` with blank labels, both drawn by ``seed``.

    FileExistsError if the sheet is there: people may have labelled it.
    """
    path = Path(path)
    if path.exists():
        raise FileExistsError(f"{path} exists and may hold labels")
    drawn = portable_sample(test.select(id_col, text_col), rows, seed, id_col).orderBy(id_col).collect()  # the sheet's own size
    picked = sorted(questions, key=lambda q: hashlib.md5(f"{seed}|{q[0]}".encode()).hexdigest())[:per]
    asked = [q for q in questions if q in picked]
    sheet = [{"complaint_id": r[0], "question_id": q, "question": text, "narrative": r[1], "label": ""} for r in drawn for q, text in asked]
    write_sheet(sheet, path, ["complaint_id", "question_id", "question", "narrative", "label"])
    return path


def longest(df: DataFrame, text_col: str, id_col: str, n: int) -> DataFrame:
    """The ``n`` longest texts, longest first."""
    return df.orderBy(F.desc(F.length(text_col)), id_col).limit(n)
