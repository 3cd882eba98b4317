"""Mixing sources to target weights by Pfair scheduling.

Each source's records, in a hashed order, are laid end to end (once per repetition) and cut into blocks of
equal tokens.  Block k of a source of weight w is released at slot floor(k / w) and due at ceil((k + 1) / w); earliest
deadline first over the released blocks interleaves the sources so that each is always less than one
block from its share.  Weights are exact fractions of whole tokens and windows follow from the block's number by integer arithmetic, so
nothing is rounded and nothing drifts.  The schedule is made on the driver; blocks are as large as it takes
to have at most ``MAX_BLOCKS`` of them, which bounds the schedule for any supply.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerlab.llm.tokens import DEFAULT_RANKS, with_token_counts
from answerlab.session import BROADCAST_ROWS, materialize, spread

#: Tokens of a block at least, and blocks of a mixture at most.
BLOCK_TOKENS, MAX_BLOCKS = 8_192, 1 << 19


def normal_source(column):
    """Spelling variants of a source are one: letter case, hyphens and outer blanks don't count."""
    return F.translate(F.lower(F.trim(column)), "-", "_")


def demands(supply: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None, hopeless: float = 0.1) -> dict[str, int]:
    """Tokens to draw of each source.

    ``targets`` is source -> (share, greatest number of uses of a record).  Without ``total`` it is the
    largest at which every source meets its share, leaving out those that could not even at
    ``hopeless`` of the supply; these give all they may.
    """
    reach = {s: supply.get(s, 0) * most / share for s, (share, most) in targets.items() if share > 0}
    if total is None:
        floor = hopeless * sum(supply.get(s, 0) for s in targets)
        able = [r for r in reach.values() if r > 0 and r >= floor] or [r for r in reach.values() if r > 0] or [0]
        total = int(min(able))
    return {s: int(min(share * total, supply.get(s, 0) * most)) for s, (share, most) in targets.items()}


def block_size(wanted: dict[str, int], least: int = BLOCK_TOKENS, most: int = MAX_BLOCKS) -> int:
    """Tokens of a block: ``least``, or what gives ``most`` blocks."""
    return max(least, -(-sum(wanted.values()) // most))


def schedule(wanted: dict[str, int], block: int) -> list[str]:
    """The source of each slot, by earliest deadline among the released blocks.

    ``wanted`` is tokens a source; its last block may be part of one.
    """
    live = {s: n for s, n in wanted.items() if n > 0}
    total = sum(live.values())
    blocks = {s: -(-n // block) for s, n in live.items()}
    waiting = [(0, s, 0) for s in sorted(live)]  # (release, source, block)
    ready: list[tuple[int, str, int]] = []  # (deadline, source, block)
    slots: list[str] = []
    t = 0
    while waiting or ready:
        if not ready and waiting[0][0] > t:
            t = waiting[0][0]  # only at the end, when some sources have no blocks left
        while waiting and waiting[0][0] <= t:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // live[s]), s, k))
        _, s, k = heapq.heappop(ready)
        slots.append(s)
        t += 1
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, ((k + 1) * total // live[s], s, k + 1))
    return slots


def mixed(
    documents: DataFrame,
    id_col: str,
    text_col: str,
    source_col: str,
    targets: DataFrame,
    total: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
    ranks: str = DEFAULT_RANKS,
) -> DataFrame:
    """The mixture: ``(slot, offset, source, doc_id, use_no, n_tokens)``, ordered by slot and offset.

    ``targets`` is the fixed table ``(source, target_share, max_repeats)`` of a few rows.  Records of
    other or null sources, null ids and texts that are null or have no tokens take no part; repeated rows are
    one record.  Without supply the result is empty.
    """
    plan = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.select(normal_source(F.col("source")).alias("source"), "target_share", "max_repeats").collect()}
    rows = documents.select(F.col(id_col).alias("doc_id"), normal_source(F.col(source_col)).alias("source"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("source").isin(list(plan)))
    buckets = spread(rows, 8, 64)
    sized = with_token_counts(rows, "text", ["doc_id", "source"], ranks).where("n_tokens > 0")
    sized = sized.groupBy("doc_id", "source").agg(F.max("n_tokens").alias("n_tokens"))
    order = F.xxhash64("doc_id", "source")
    sized = materialize(sized.withColumn("order", order).withColumn("bucket", F.shiftright(order, 32) % buckets + buckets))
    # where each record starts in its source: sums per bucket first, then inside the buckets, so that
    # no task holds a whole source
    sums = sized.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    supply = {r["source"]: r["tokens"] for r in sums.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    wanted = demands(supply, plan, total)
    size = block_size(wanted, block_tokens)
    slots = schedule(wanted, size)
    spark = documents.sparkSession
    schema = "slot long, offset long, source string, doc_id {}, use_no int, n_tokens long".format(sized.schema["doc_id"].dataType.simpleString())
    if not slots:
        return spark.createDataFrame([], schema)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))).drop("tokens")
    inside = Window.partitionBy("source", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(F.broadcast(bases) if buckets * len(plan) < 200_000 else bases, ["source", "bucket"]).withColumn(
        "start", F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    )
    demand = spark.createDataFrame([(s, n, supply.get(s, 0), plan[s][1]) for s, n in wanted.items() if n], "source string, want long, have long, most int")
    uses = (
        placed.join(F.broadcast(demand), "source")
        .withColumn("full", F.floor(F.col("want") / F.col("have")))
        # half a record's tokens decide whether the last repetition still takes it
        .withColumn("more", (F.col("start") + F.col("n_tokens") / 2 <= F.col("want") - F.col("full") * F.col("have")).cast("int"))
        .withColumn("uses", F.least(F.col("full") + F.col("more"), F.col("most")).cast("int"))
        .where("uses > 0")
        .withColumn("use_no", F.explode(F.sequence(F.lit(1), F.col("uses"))))
        .withColumn("at", (F.col("use_no") - 1) * F.col("have") + F.col("start"))
        .withColumn("block", F.floor(F.col("at") / size).cast("long"))
    )
    turns: dict[str, int] = {}
    number = []
    for s in slots:
        number.append(turns.get(s, 0))
        turns[s] = number[-1] + 1
    plan_rows = spark.createDataFrame(pd.DataFrame({"source": slots, "block": number, "slot": range(len(slots))}), "source string, block long, slot long")
    # the last repetition may begin in the tokens after the last block: it stays in that block
    last = spark.createDataFrame(list(turns.items()), "source string, blocks long")
    keyed = uses.join(F.broadcast(last), "source").withColumn("block", F.least("block", F.col("blocks") - 1))
    side = F.broadcast(plan_rows) if len(slots) <= BROADCAST_ROWS else plan_rows
    return keyed.join(side, ["source", "block"]).select(
        "slot",
        (F.col("at") - F.col("block") * size).cast("long").alias("offset"),
        "source",
        "doc_id",
        "use_no",
        "n_tokens",
    )


def deviations(mixture: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per source ``(source, weight, blocks, largest_deviation, largest_token_deviation)`` over all slots of a mixture.

    ``weight`` is the source's share of the mixture's tokens.  ``largest_deviation`` is that of its number of blocks from
    weight times slots, ``largest_token_deviation`` that of its tokens from weight times tokens so far, in blocks of the
    schedule; records are not cut, so the latter may exceed the former by a record.  A mixture has at most ``MAX_BLOCKS`` slots
    and some, which is what the running sums hold.
    """
    per = mixture.groupBy("slot", "source").agg(F.sum("n_tokens").alias("tokens"))
    total = per.agg(F.sum("tokens").alias("all_tokens"))
    size = F.greatest(F.lit(block_tokens), F.ceil(F.col("all_tokens") / MAX_BLOCKS))
    upto = Window.orderBy("slot")  # one row a slot
    rows = per.select("slot", "source", "tokens", F.sum("tokens").over(upto).alias("done")).join(F.broadcast(total)).withColumn("size", size)
    own = Window.partitionBy("source").orderBy("slot")
    rows = rows.withColumn("mine", F.sum("tokens").over(own)).withColumn("k", F.row_number().over(own))
    weight = F.sum("tokens").over(Window.partitionBy("source")) / F.col("all_tokens")
    rows = rows.withColumn("weight", weight)
    # a source is furthest ahead just after one of its slots and furthest behind just before
    after = F.abs(F.col("k") - F.col("weight") * (F.col("slot") + 1))
    before = F.abs(F.col("k") - 1 - F.col("weight") * F.col("slot"))
    token_after = F.abs(F.col("mine") - F.col("weight") * F.col("done"))
    token_before = F.abs(F.col("mine") - F.col("tokens") - F.col("weight") * (F.col("done") - F.col("tokens")))
    return rows.groupBy("source").agg(
        F.max("weight").alias("weight"),
        F.count(F.lit(1)).alias("blocks"),
        F.max(F.greatest(after, before)).alias("largest_deviation"),
        F.max(F.greatest(token_after, token_before) / F.col("size")).alias("largest_token_deviation"),
    )


def share_report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: ``(source, target_share, actual_share, tokens, records, most_uses, max_repeats, met)``.

    A source is met if its actual share is within one hundredth of the total of its target.
    """
    per_doc = mixture.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"))
    per = per_doc.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("records"), F.max("uses").alias("most_uses"))
    total = per.agg(F.sum("tokens").alias("all_tokens"))
    want = targets.select(normal_source(F.col("source")).alias("source"), "target_share", "max_repeats")
    share = F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0))
    return (
        want.join(per, "source", "left")
        .join(F.broadcast(total))
        .select(
            "source",
            "target_share",
            share.alias("actual_share"),
            *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("tokens", "records", "most_uses")),
            "max_repeats",
            (F.abs(share - F.col("target_share")) <= 0.01).alias("met"),
        )
    )
