"""Mixing sources to target weights with a low-discrepancy slot schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orequarry.llm.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: The fractional part of the golden ratio.
GOLDEN = 0.6180339887498949
#: Up to so many sources, their totals are broadcast.
SMALL = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float, most: float, weights: tuple[float, ...]) -> DataFrame:
    """source, source_size, weight, target: `share` of all words by weight, none above `most` times its size.

    One row per source comes in. In order of most * size / weight, let each source's level be what the
    ones before it leave when full, by weight among the rest. The level rises while sources fill up and
    falls after the first that doesn't, so its maximum is where resharing the excess comes to rest.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), place)).withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, every = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(upto), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    )
    rest = ranked.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return rest.withColumn("target", F.least("limit", F.col("weight") * F.col("level"))).select("source", "source_size", "weight", "target")


def slot_schedule(targets: DataFrame, slots: int) -> DataFrame:
    """source_key, slot, turn (from 0): golden-ratio points of the slots mapped through the cumulative targets.

    `slots` is a fixed parameter, so the table has the same bounded length for any corpus; a mix of fewer
    words than that has one slot a word.
    """
    cum = Window.orderBy("source_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = targets.where("target > 0").withColumn("upper", F.sum("target").over(cum))
    edges = edges.select(
        "source_key", F.ceil(F.col("total") / F.col("block")).alias("used"),
        ((F.col("upper") - F.col("target")) / F.col("total")).alias("low"), (F.col("upper") / F.col("total")).alias("high"),
    )
    points = targets.sparkSession.range(slots).select(F.col("id").alias("slot"), ((F.col("id") + 0.5) * F.lit(GOLDEN) % 1.0).alias("point"))
    cells = 1024
    cell = edges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))))
    hit = points.withColumn("cell", F.floor(F.col("point") * cells)).join(cell, "cell").where("point >= low AND point < high AND slot < used")
    order = Window.partitionBy("source_key").orderBy("slot")
    return hit.select("source_key", "slot", (F.row_number().over(order) - 1).cast("long").alias("turn"))


def whole_schedule(plan: DataFrame, dealt: DataFrame) -> DataFrame:
    """source_key, slot, turn: the dealt slots that a source needs for its `need` blocks, and places for those it lacks.

    A source gets a few slots more or less than its target asks for. A turn without a slot stands where
    an even spread over the `used` slots has it, beside the slot that lies there.
    """
    asked = plan.where("need > 0").select("source_key", "need", "used")
    have = dealt.groupBy("source_key").agg(F.count(F.lit(1)).alias("granted"))
    lacks = asked.join(have, "source_key", "left").withColumn("granted", F.coalesce("granted", F.lit(0))).where("granted < need")
    lacks = lacks.select("source_key", "need", "used", F.explode(F.sequence(F.col("granted"), F.col("need") - 1)).alias("turn"))
    more = lacks.select("source_key", F.floor((F.col("turn") + 0.5) * F.col("used") / F.col("need")).alias("slot"), "turn")
    return dealt.join(asked, "source_key").where("turn < need").select("source_key", "slot", "turn").unionByName(more)


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    most: float = 2.0,
    weights: tuple[float, ...] = WEIGHTS,
    slots: int = 1 << 17,
    ranges: int = 512,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot: one row per row of docs.

    A null or blank text has size 0 and takes nothing; a null source is a source of its own, last in
    order. Where all sizes are 0 every target is 0. Rows that repeat an id are told apart by their
    texts; rows equal in both may stand for each other. No rows give no rows. Other columns are ignored.

    The documents of a source lie on its token axis in the order of a hash of id and text. The axis is
    cut into blocks of equal tokens and wraps round, so a second pass takes each document again. The
    schedule deals slots to sources; a source's k-th slot takes its k-th block, the last one in part, so
    a source gives its target, rounded to words, also where that is less than a block. A source with
    fewer slots than blocks has the others beside slots of the even spread. taken is what the blocks of
    a document that are joined to slots hold of it; first_slot is the first of these slots. Positions are
    running sums in two steps (`ranges` hash ranges per source, then inside a range), so no task ever
    holds a whole source.
    """
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    rows = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
            F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.monotonically_increasing_id().alias("row"),
        )
        .withColumn("source_key", key)
        .withColumn("range", F.pmod(F.shiftright("h", 20), F.lit(ranges)))
    )
    per_range = rows.groupBy("source_key", "source", "range").agg(F.sum("size").alias("range_size"))
    per_source = per_range.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    every = Window.partitionBy()
    targets = source_targets(per_source, share, most, weights).withColumn("source_key", key).drop("source")
    targets = targets.withColumn("total", F.sum("target").over(every))
    # tokens of one slot: a fixed part of the mix, so the schedule stays as fine at any size
    targets = materialize(targets.withColumn("block", F.greatest(F.ceil(F.col("total") / slots), F.lit(1)).cast("long")))
    end = F.least(F.round("target").cast("long"), F.floor(F.lit(float(most)) * F.col("source_size")))
    plan = targets.select("source_key", "source_size", "target", "block", "total", end.alias("end"))
    plan = plan.withColumn("need", F.expr("(end + block - 1) div block")).withColumn("used", F.ceil(F.col("total") / F.col("block")))
    turns = materialize(whole_schedule(plan, materialize(slot_schedule(targets, slots))))
    plan = plan.select("source_key", "source_size", "target", "block", "end")
    small = targets.limit(SMALL + 1).count() <= SMALL
    plan, turns = (F.broadcast(plan), F.broadcast(turns)) if small else (plan, turns)  # turns: at most slots and two for each source
    before = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_range.select("source_key", "range", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("range_start"))
    inside = Window.partitionBy("source_key", "range").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = (
        rows.withColumn("offset", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, ["source_key", "range"])
        .join(plan, "source_key")
        .withColumn("low", F.col("range_start") + F.col("offset"))
    )
    blocks = laid.select("row", "source_key", "doc_id", "size", "source_size", "target", "block", F.explode_outer(pieces(most)).alias("piece"))
    joined = blocks.withColumn("turn", F.col("piece.turn")).join(turns, ["source_key", "turn"], "left")
    words = F.when(F.col("slot").isNotNull(), F.least("piece.high", (F.col("turn") + 1) * F.col("block")) - F.greatest("piece.low", F.col("turn") * F.col("block")))
    taken = joined.withColumn("words", F.coalesce(words, F.lit(0))).groupBy("row").agg(
        *[F.first(x).alias(x) for x in ("doc_id", "size", "source_size", "target")], F.sum("words").cast("long").alias("taken"), F.min("slot").alias("first_slot")
    )
    return taken.drop("row")


def pieces(most: float) -> Column:
    """The blocks that a document lies in, in each pass up to the end of its source's target: turn, and low and high of it in that pass."""
    passes = F.sequence(F.lit(0), F.lit(int(-(-most // 1)) - 1))
    begin = lambda p: F.col("low") + p * F.col("source_size")
    high = lambda p: F.least(begin(p) + F.col("size"), F.col("end"))
    turns = lambda p: F.when(
        high(p) > begin(p),
        F.transform(
            F.sequence(F.floor(begin(p) / F.col("block")).cast("long"), F.floor((high(p) - 1) / F.col("block")).cast("long")),
            lambda turn: F.struct(turn.alias("turn"), begin(p).alias("low"), high(p).alias("high")),
        ),
    )
    return F.flatten(F.filter(F.transform(passes, turns), lambda x: x.isNotNull()))
