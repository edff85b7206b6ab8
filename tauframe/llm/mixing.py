"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are shuffled by a hash and laid end to end; the stream of
tokens is cut into blocks of equal size: at most ``block`` tokens, less in a source that
would have under ``LEAST_BLOCKS`` of them, never differing by more than one token. Slot i
of the mix is the point frac(i * golden ratio), mapped to a source through the cumulative
numbers of slots that the targets call for. The slots of a source are ranked, and rank r
takes the source's block r modulo its number of blocks; the quotient is the epoch. Block
for block the mix hence follows the weights at every prefix, and the tokens taken from a
source differ from its target by a few of its blocks, whatever the size of the corpus or
of the source.

Targets: weights share the sum of all sizes; a target stops at ``max_epochs`` times its
source's size and the excess is shared again by weight among the others, until none is
above. Slots of a rank beyond the last epoch find no block, so nothing is taken more than
``max_epochs`` times.

Choices: sources are ordered by code point, the null source last. A null text has no
tokens; documents without tokens are returned with nothing taken. A null id sorts first;
repeated rows are separate documents. An empty table gives no rows. Only id, text and
source are read. All arithmetic that decides is in integers, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tauframe.llm.storage import checkpoint, free_name, with_locator
from tauframe.operators.ordered import running_totals

#: Points are whole numbers below 2**62; the step is the golden ratio's fraction of that,
#: made odd, so that 2**62 slots in a row meet every point once.
HALF = 1 << 31
POINTS = HALF * HALF
GOLDEN_STEP = 2850178704830799621
#: Shares of the points are looked up by cells of 2**52 points.
CELL_BITS = 52
#: A source is cut into this many blocks or more, as far as it has the words.
LEAST_BLOCKS = 64
#: Slots that one window ranks.
SLOT_CHUNK = 1 << 15
WHITE = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space and 9 to 13."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.lit(0)).otherwise(
        F.size(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))).cast("long")


def source_targets(sources: DataFrame, weights: list[int], max_epochs: int) -> DataFrame:
    """(source, source_size, rank, target) from (source, source_size).

    The level of the water filling has a closed form: ordered by limit per weight, the
    sources up to some place stop at their limit, and the rest share by weight what these
    leave. There is one row for each source; the windows below have no other rows.
    """
    everyone = Window.partitionBy()
    cycle = F.array(*[F.lit(w) for w in weights])
    weight = F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    base = (
        sources.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", weight)
        .withColumn("limit", F.col("source_size") * max_epochs)
        .withColumn("total", F.sum("source_size").over(everyone))
    )
    by_need = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    earlier = by_need.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("total") - F.coalesce(F.sum("limit").over(earlier), F.lit(0))
    base = base.withColumn("level", left / F.sum("weight").over(onward))
    # From the first source on that stays below its limit, all do.
    stays = F.when(F.col("limit") > F.col("level") * F.col("weight"), F.col("level"))
    level = F.coalesce(F.max("_open").over(everyone), F.lit(float("inf")))
    first_open = F.when(F.col("_place") == F.min(F.when(F.col("_stays").isNotNull(), F.col("_place"))).over(everyone), F.col("_stays"))
    base = base.withColumn("_stays", stays).withColumn("_place", F.row_number().over(by_need))
    base = base.withColumn("_open", first_open).withColumn("_level", level)
    target = F.least(F.col("limit").cast("double"), F.col("_level") * F.col("weight"))
    return base.select("source", "source_size", "rank", target.alias("target"))


def block_counts(targets: DataFrame, block: int) -> DataFrame:
    """``targets`` of the sources with words, with their blocks and the slots they need.

    The first ``longer`` of the ``blocks`` have ``width`` + 1 words, the others ``width``.
    """
    size = F.col("source_size")
    return targets.filter("target > 0").withColumn(
        "blocks", F.greatest(F.ceil(size / block), F.least(size, F.lit(LEAST_BLOCKS))).cast("long")
    ).withColumns({
        "width": F.floor(size / F.col("blocks")), "longer": size % F.col("blocks"),
        "need": F.col("target") * F.col("blocks") / size,
    })


def _block_start(number: Column) -> Column:
    return number * F.col("width") + F.least(number, F.col("longer"))


def _block_of(word: Column) -> Column:
    """The block that holds a word, counted from 0 in its source."""
    long_words = F.col("longer") * (F.col("width") + 1)
    return F.when(word < long_words, F.floor(word / (F.col("width") + 1))).otherwise(
        F.col("longer") + F.floor((word - long_words) / F.col("width")))


def golden_point(slot: Column) -> Column:
    """slot * GOLDEN_STEP modulo 2**62, in two halves so that no product overflows."""
    high, low = F.floor(slot / HALF), slot % HALF
    step_high, step_low = divmod(GOLDEN_STEP, HALF)
    return ((high * step_low + low * step_high) % HALF * HALF + low * step_low) % POINTS


def schedule(counts: DataFrame, max_epochs: int) -> DataFrame:
    """(rank, slot, turn, block): for each slot its source, its number among the source's
    slots and the block it takes; slots beyond the last epoch are left out."""
    spark = counts.sparkSession
    total = counts.agg(F.sum("need")).first()[0] or 0
    upto = F.sum("need").over(Window.orderBy("rank"))
    whole = F.sum("need").over(Window.partitionBy())
    last = F.lead("rank").over(Window.orderBy("rank")).isNull()
    edge = F.when(last, F.lit(POINTS)).otherwise(F.round(upto / whole * POINTS).cast("long"))
    shares = counts.withColumn("hi", edge)
    shares = shares.select("rank", "hi", F.lag("hi", 1, 0).over(Window.orderBy("rank")).alias("lo")).filter("hi > lo")
    cells = shares.select("rank", "lo", "hi", F.explode(F.sequence(
        F.shiftright("lo", CELL_BITS), F.shiftright(F.col("hi") - 1, CELL_BITS))).alias("cell"))
    slots = spark.range(math.ceil(round(total, 6))).select(F.col("id").alias("slot")).withColumn(
        "point", golden_point(F.col("slot")))
    dealt = slots.withColumn("cell", F.shiftright("point", CELL_BITS)).join(cells, "cell").filter(
        "point >= lo and point < hi").select("rank", "slot")
    ranked = running_totals(
        dealt, [F.col("slot")], by=["rank"], bucket=F.floor(F.col("slot") / SLOT_CHUNK), position="_nth")
    turn = F.col("_nth") - 1
    return ranked.join(counts.select("rank", "blocks"), "rank").filter(
        turn < F.col("blocks") * max_epochs).select(
        "rank", "slot", turn.alias("turn"), (turn % F.col("blocks")).alias("block"))


def _laid_out(
    docs: DataFrame, weights: list[int], max_epochs: int, block: int, id_col: str, text_col: str, source_col: str,
) -> tuple[DataFrame, DataFrame]:
    """The rows with their places in their source's stream of words, and ``block_counts``."""
    rows = checkpoint(with_locator(docs.select(id_col, text_col, source_col), "at").select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"), "at"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = checkpoint(source_targets(sizes, weights, max_epochs))
    known = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).select(
        "doc_id", "at", "size", "source_size", "rank", "target")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    stream = running_totals(
        known.withColumn("_key", key), [F.col("_key"), F.col("at")], sums={"_upto": F.col("size")}, by=["rank"])
    stream = checkpoint(stream.drop("_key", "pos").withColumn("_from", F.col("_upto") - F.col("size")))
    return stream, checkpoint(block_counts(targets, block))


def mix_sources(
    docs: DataFrame,
    weights: list[int],
    max_epochs: int = 3,
    block: int = 32,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(doc_id, at, size, source_size, target, taken) for every row of ``docs``.

    ``taken`` is the number of words that the mix takes of the row, repeats counted; all
    of a source's documents but one or two are taken whole, a number of times.
    """
    stream, counts = _laid_out(docs, weights, max_epochs, block, id_col, text_col, source_col)
    shape = counts.select("rank", "width", "longer")
    number = F.explode(F.sequence(_block_of(F.col("_from")), _block_of(F.col("_upto") - 1))).alias("block")
    pieces = stream.filter("size > 0").join(shape, "rank").select(
        "rank", "at", "_from", "_upto", "width", "longer", number).select(
        "rank", "at", "block",
        (F.least(F.col("_upto"), _block_start(F.col("block") + 1))
         - F.greatest(F.col("_from"), _block_start(F.col("block")))).alias("words"))
    times = schedule(counts, max_epochs).groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = pieces.join(times, ["rank", "block"]).groupBy("at").agg(
        F.sum(F.col("words") * F.col("times")).alias("taken"))
    return stream.join(taken, "at", "left").select(
        "doc_id", "at", "size", "source_size", "target",
        F.coalesce(F.col("taken"), F.lit(0)).cast("long").alias("taken"))


def mixed_documents(
    docs: DataFrame, weights: list[int], max_epochs: int = 3, block: int = 32, in_order: bool = True,
) -> DataFrame:
    """``docs`` as whole documents in the order of the schedule.

    A document comes once for every slot that takes the block its first word lies in, at
    that slot, so the documents of a source have its target of words up to a few blocks
    and documents, and so has every prefix in proportion. Rows are range partitioned and
    sorted by slot, then by place in the source's stream. Without ``in_order`` this last
    shuffle of the texts is spared. Documents without words are not taken.
    """
    at, slot, first = (free_name(docs, name) for name in ("_at", "_slot", "_first"))
    located = with_locator(docs, at)
    stream, counts = _laid_out(located.drop(at), weights, max_epochs, block, "doc_id", "text", "source")
    starts = stream.filter("size > 0").join(counts.select("rank", "width", "longer"), "rank").select(
        "rank", F.col("at").alias(at), F.col("_from").alias(first), _block_of(F.col("_from")).alias("block"))
    plan = starts.join(schedule(counts, max_epochs), ["rank", "block"]).select(at, first, F.col("slot").alias(slot))
    mixed = located.join(plan, at)
    if in_order:
        mixed = mixed.repartitionByRange(F.col(slot), F.col(first)).sortWithinPartitions(slot, first)
    return mixed.select(docs.columns)
