"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are put in a shuffled order and its words cut into
blocks of equal length. Point i of the golden-ratio sequence, frac((i + 1) * phi),
is mapped through the cumulative weights of the sources: slot i belongs to the
source whose interval holds the point. Slots are ranked within their source, and
rank r takes block r, starting again when all blocks were used. Any prefix of the
schedule holds each source in proportion to its weight, up to a few blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, WORD
from tidemark.session import materialize

#: A source is used this many times over at most.
MOST_USES = 3
#: Words in a block.
BLOCK_WORDS = 256
#: Slots or documents whose order one window call settles.
CHUNK = 1 << 14
#: Cells of the unit interval in which points and sources meet.
GRID = 4096
_PHI = 0.6180339887498949


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, source, size): words of every document, null text having none."""
    count = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(key).alias("id"), F.col(source).alias("source"), count.alias("size"))


def _by_code_point(name: str) -> list[Column]:
    # UTF-8 keeps the order of code points; the plain string comparison of Spark is binary
    return [F.col(name).isNull(), F.col(name)]


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target): one row a source.

    Sources in the order of their names, null last, weigh 1, 2, 3, 1, ... and
    share all words. A target stops at ``MOST_USES`` times its source's words; the
    excess goes to the others by weight until none is above. With sources sorted
    by cap / weight the filled ones are a prefix of that order, so running sums
    over the sources (a handful of rows) settle it without iteration.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = totals.withColumn("place", F.row_number().over(Window.orderBy(*_by_code_point("source"))) - 1)
    weighed = named.withColumn("weight", (F.col("place") % 3 + 1).cast("double")).withColumn("cap", (F.col("source_size") * MOST_USES).cast("double"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    everything = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    share = (
        weighed.withColumn("all_words", F.sum("source_size").over(everything).cast("double"))
        .withColumn("left", F.col("all_words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("weights"))
    )
    # the water level: that of the first source which it does not fill
    level = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct("place_in_level", "level"))).over(everything)
    ranked = share.withColumn("place_in_level", F.row_number().over(by_level)).withColumn("water", level["level"])
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col("weight")))
    return ranked.select("source", F.col("source_size").cast("long").alias("source_size"), target.alias("target"))


def _running(rows: DataFrame, group: str, order: str, amount: str, chunks: Column, out: str) -> DataFrame:
    """Sum of ``amount`` in rows of the same ``group`` before this one in ``order``.

    ``chunks`` maps order to consecutive chunk numbers. Chunk sums are summed
    first, then rows within their chunk: no window holds a whole group's rows.
    """
    cut = rows.withColumn("__chunk", chunks)
    sums = cut.groupBy(group, "__chunk").agg(F.sum(amount).alias("__in"))
    # bounded: rows / CHUNK rows in all, one small row each
    ahead = Window.partitionBy(group).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col(group).alias("__group"), F.col("__chunk").alias("__at"), F.coalesce(F.sum("__in").over(ahead), F.lit(0)).alias("__before"))
    placed = cut.join(starts, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__chunk") == F.col("__at")))
    within = Window.partitionBy(group, "__chunk").orderBy(order, "id").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn(out, F.col("__before") + F.coalesce(F.sum(amount).over(within), F.lit(0))).drop("__chunk", "__group", "__at", "__before")


def shuffled(sized: DataFrame, seed: int = 7) -> DataFrame:
    """Every document with ``begin``: its first word's place in its source's shuffled stream of words."""
    rows = sized.count()
    parts = max(1, -(-rows // CHUNK))
    turn = sized.withColumn("turn", F.xxhash64(F.lit(seed), F.col("id")))
    # the hash is even over its range, so equal ranges of it are chunks of about equal size
    part = F.floor((F.col("turn").cast("double") / F.lit(2.0**64) + 0.5) * parts)
    return _running(turn, "source", "turn", "size", F.least(part, F.lit(parts - 1)), "begin").drop("turn")


def schedule(goal: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """(slot, source, rank, turn, first, words): which words of its source's stream each slot takes.

    A source's last slot is cut so that its slots add up to its target, rounded
    down to whole words and never above ``MOST_USES`` times its words. The sequence
    gives a source a few slots more or less than that takes: those beyond are left
    empty, those missing follow at the end.
    """
    spark = goal.sparkSession
    quota = F.least(F.floor(F.col("target")), F.col("source_size") * MOST_USES).cast("long")
    all_sources = Window.partitionBy()
    upto = Window.orderBy(*_by_code_point("source"))
    per_pass = F.ceil(F.col("source_size") / block)
    cuts = (
        goal.withColumn("quota", quota)
        .where("quota > 0")
        .withColumn("place", F.row_number().over(upto))
        .withColumn("below", F.coalesce(F.sum("quota").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("words_all", F.sum("quota").over(all_sources))
        .withColumn("low", F.col("below") / F.col("words_all"))
        .withColumn("high", F.coalesce(F.lead("low").over(upto), F.lit(1.0)))
        .withColumn("ranks", F.floor(F.col("quota") / F.col("source_size")) * per_pass + F.ceil((F.col("quota") % F.col("source_size")) / block))
    )
    cuts = materialize(cuts)
    words = cuts.agg(F.sum("quota").alias("words")).first()["words"] or 0
    need = -(-words // block)
    # points meet the cuts by grid cell: an equi-join, with one or two sources in most cells
    cell = F.explode(F.sequence(F.floor(F.col("low") * GRID), F.least(F.floor(F.col("high") * GRID), F.lit(GRID - 1))))
    edges = cuts.select("source", "low", "high", cell.alias("cell"))
    point = F.expr(f"(id + 1) * {_PHI!r} - floor((id + 1) * {_PHI!r})")
    drawn = spark.range(need).withColumn("point", point).withColumn("cell", F.floor(F.col("point") * GRID))
    owned = drawn.join(edges, (drawn["cell"] == edges["cell"]) & (F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
    owned = owned.select("id", "source", F.lit(1).cast("long").alias("one"))
    drawn_ranks = _running(owned, "source", "id", "one", F.floor(F.col("id") / CHUNK), "rank").select("id", F.col("source").alias("of"), "rank")
    had = owned.groupBy(F.col("source").alias("of")).agg(F.count(F.lit(1)).alias("had"))
    met = cuts.join(had, F.col("source").eqNullSafe(F.col("of")), "left").drop("of").withColumn("had", F.coalesce("had", F.lit(0)))
    late = met.where("had < ranks").withColumn("rank", F.explode(F.expr("sequence(had, ranks - 1)")))
    late = late.select((F.lit(need) + F.col("rank") * F.max("place").over(all_sources) + F.col("place")).alias("id"), F.col("source").alias("of"), "rank")
    ranked = drawn_ranks.unionByName(late).join(cuts, F.col("of").eqNullSafe(F.col("source")))
    place = (F.col("rank") % per_pass) * block
    width = F.least(F.lit(block), F.col("source_size") - place)
    # words taken by all earlier ranks of the source
    done = F.floor(F.col("rank") / per_pass) * F.col("source_size") + place
    words = F.least(width, F.col("quota") - done)
    turn = F.floor(F.col("rank") / per_pass)
    return ranked.select(F.col("id").alias("slot"), "source", "rank", turn.alias("turn"), place.alias("first"), words.alias("words")).where("words > 0")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """The mix and its documents.

    First (slot, turn, id, begin, words): the words of document ``id`` that slot ``slot``
    takes in pass ``turn`` over its source, counted from the document's word ``begin``. Second (id, source, size, source_size,
    target). Empty and null texts take no part in the mix. Equal ids are told apart
    only by their size: rows repeated in full hold words of their own but share the
    id. A null source is a source. An empty table gives two empty results.
    """
    sized = materialize(sizes(docs, key, text, source))
    goal = materialize(targets(sized))
    placed = shuffled(sized).where("size > 0")
    span = F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))
    pieces = placed.withColumn("block", F.explode(span)).withColumnRenamed("source", "own")
    slots = schedule(goal, block).withColumn("slot_block", F.floor(F.col("first") / block))
    met = slots.join(pieces, F.col("source").eqNullSafe(F.col("own")) & (F.col("slot_block") == F.col("block")))
    start = F.greatest(F.col("first"), F.col("begin"))
    end = F.least(F.col("first") + F.col("words"), F.col("begin") + F.col("size"))
    rows = met.select("slot", "turn", "id", (start - F.col("begin")).alias("begin"), (end - start).alias("words")).where("words > 0")
    facts = sized.join(goal.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own"))).drop("own")
    return rows, facts


def taken(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, taken): how many words the mix takes of every document."""
    rows, facts = mix(docs, key, text, source)
    counts = rows.groupBy(F.col("id").alias("of")).agg(F.sum("words").alias("taken"))
    met = facts.join(counts, F.col("id").eqNullSafe(F.col("of")), "left")
    return met.select("id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK_WORDS) -> DataFrame:
    """The mix in the columns of ``docs``: a row for each pass over a source that takes words of the document.

    A pass that takes all words leaves the text as it is; one that takes some leaves
    these words, in order, joined by single spaces. A document of no words has no
    part in the mix. Rows that share an id must be one document.
    """
    rows, facts = mix(docs, key, text, source, block)
    passes = rows.groupBy("id", "turn").agg(
        F.sum("words").alias("n"), F.sort_array(F.collect_list(F.struct("begin", "words"))).alias("parts")
    )
    size = facts.where("size > 0").groupBy(F.col("id").alias("of")).agg(F.max("size").alias("size"))
    met = passes.join(size, F.col("id").eqNullSafe(F.col("of")))
    taken_by = met.select(F.col("id").alias("__id"), F.when(F.col("n") < F.col("size"), F.col("parts")).alias("__parts"))
    words = F.filter(F.split(F.col(text), SPACE + "+"), lambda w: w != "")
    some = F.element_at(
        F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform(F.col("__parts"), lambda p: F.slice(w, p["begin"].cast("int") + 1, p["words"].cast("int")))), " ")), 1
    )
    met = docs.join(taken_by, F.col(key).eqNullSafe(F.col("__id")))
    cut = F.when(F.col("__parts").isNull(), F.col(text)).otherwise(some)
    kept = [F.col(name) if name != text else cut.alias(text) for name in docs.columns]
    return met.select(*kept)
