"""Exact deduplication with a heavy-hitter split.

Texts are equal when they agree after removing white space; null counts as
empty. A bounded frequent-items summary (a Misra-Gries sketch, merged over all
partitions) names the digests that may be frequent. Their groups are counted
exactly with map-side partial sums and their winners are broadcast, so the
copies of a frequent text leave the flow on the map side. All other digests meet
in an ordinary shuffle, where no group can be large: the sketch misses no digest
with more than rows / ``tracked`` copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES
from tidemark.session import materialize

#: Digests the sketch tracks and, at most, broadcasts: a fixed bound, whatever the data.
TRACKED = 1024
FREQUENT = 256


def digest_of(text: str) -> Column:
    """SHA-256 (hex) of the text without white space; null is empty."""
    return F.sha2(F.translate(F.coalesce(F.col(text), F.lit("")), SPACES, "").cast("binary"), 256)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, length, digest): code points of the text and SHA-256 of it without white space."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("id"),
        F.length(body).cast("long").alias("length"),
        digest_of(text).alias("digest"),
    )


def frequent_digests(marks: DataFrame) -> DataFrame:
    """At most ``FREQUENT`` digests that the merged sketch holds to be most frequent."""
    top = marks.agg(F.expr(f"approx_top_k(digest, {FREQUENT}, {TRACKED})").alias("top"))
    return top.select(F.explode("top").alias("one")).select(F.col("one.item").alias("digest")).where("digest is not null")


def _winners(marks: DataFrame) -> DataFrame:
    best = F.min(F.struct((-F.col("length")).alias("less"), F.col("id")))
    return marks.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).select(
        "digest", F.col("best.id").alias("keep_id"), F.col("group_size").cast("long")
    )


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, length, digest, keep_id, group_size) for every row of ``docs``.

    Of equal texts the longest original stays, then the smallest id. Null and
    white-space-only texts form one group. Rows repeated in full are members of
    their group like any other and share its keep_id. An empty table gives an
    empty result; columns other than id and text are not read.
    """
    marks = materialize(digests(docs, key, text))
    # Both lists hold FREQUENT rows at most; writing them fixes one evaluation of the sketch.
    names = materialize(frequent_digests(marks))
    hot = materialize(_winners(marks.join(F.broadcast(names), "digest", "left_semi")))
    by_map = marks.join(F.broadcast(hot), "digest")
    rest = marks.join(F.broadcast(names), "digest", "left_anti")
    by_shuffle = rest.join(_winners(rest), "digest")
    columns = ["id", "length", "digest", "keep_id", "group_size"]
    return by_map.select(columns).unionByName(by_shuffle.select(columns))


def _row_of(key: Column, digest: Column) -> Column:
    """One string for an id and a digest, a null id included: joins and windows share its partitioning."""
    return F.concat(F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("-")), F.lit(" "), digest)


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` that stay, with the columns of ``docs``.

    A row repeated in full (same id, same text) stays once; of rows that share an id
    and differ in white space only, the longest, then the first by text. Whole rows are
    shuffled once, with their columns in a struct, so that no name clashes.
    """
    groups = exact_groups(docs, key, text)
    winners = groups.where(F.col("id").eqNullSafe(F.col("keep_id")))
    keep = winners.select(_row_of(F.col("id"), F.col("digest")).alias("row"))
    body = F.coalesce(F.col(text), F.lit(""))
    marked = docs.select(F.struct("*").alias("whole"), _row_of(F.col(key), digest_of(text)).alias("row"), F.length(body).alias("length"))
    order = [F.desc("length"), F.col("whole").getField(text)]
    turn = F.row_number().over(Window.partitionBy("row").orderBy(*order))
    return marked.join(keep, "row", "left_semi").withColumn("turn", turn).where("turn = 1").select("whole.*")
