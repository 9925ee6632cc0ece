"""Exact order statistics that never put a whole group into one task.

Each key is cut into pieces at sampled quantiles of its values. A value that is
itself a cut point gets a piece of its own: a value held by a large share of
the rows always is one, and rows of such a piece share one rank, so they need
no sorting and are spread over tasks. What lies between two cut points is small
and is ordered in one window. Piece sizes come from a pre-aggregated count.

Cut points only decide the balance, but all branches of a plan must see the same
ones: they are evaluated once and written before they are used.
``keys`` are report dimensions (a score, a fold, a feature/target pair): their
number is fixed by the call and not by the data, which bounds the broadcast
tables at (keys x pieces) rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

SALTS = 64


def pieces_per_key(df: DataFrame) -> int:
    """A power of two of at least twice the shuffle width, between 8 and 4,096."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = 8
    while pieces < 2 * width and pieces < 4096:
        pieces *= 2
    return pieces


def _meet(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(F.broadcast(small), list(keys)) if keys else df.crossJoin(F.broadcast(small))


def _piece(value: Column, cuts: Column, pieces: int) -> Column:
    """Even number: between two cut points; odd number: equal to a cut point.

    Binary search over pieces − 1 sorted cut points.
    """
    steps, step = [], pieces // 2
    while step:
        steps.append(step)
        step //= 2
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: F.when(F.get(cuts, at + s - 1) < value, at + s).otherwise(at),
        lambda at: at * 2 + F.coalesce((F.get(cuts, at) == value).cast("int"), F.lit(0)),
    )


def with_pieces(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Add ``_piece_<value>`` for every value column (values must not be NULL)."""
    pieces = pieces_per_key(df)
    at = [i / pieces for i in range(1, pieces)]
    cuts = df.groupBy(*keys).agg(
        *[F.percentile_approx(v, at, max(1000, 8 * pieces)).alias(f"_cuts_{v}") for v in values]
    )
    # a sketch merges in any order: one evaluation serves sizes and rows alike (keys x pieces values)
    out = _meet(df, materialize(cuts), keys)
    own = [_piece(F.col(v), F.col(f"_cuts_{v}"), pieces).alias(f"_piece_{v}") for v in values]
    return out.select(*df.columns, *own)


def _piece_sizes(split: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows in each piece and in all pieces before it."""
    piece = f"_piece_{value}"
    earlier = Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    return (
        split.groupBy(*keys, piece)
        .agg(F.count(F.lit(1)).alias("_in_piece"), F.min(value).alias("_least"))
        .withColumn("_before_piece", F.coalesce(F.sum("_in_piece").over(earlier), F.lit(0)))
    )


def with_ranks(df: DataFrame, keys: Sequence[str], ranks: dict[str, str], salt: str | None = None) -> DataFrame:
    """Average 1-based rank of each row per value column: ``ranks`` maps value to output.

    ``salt`` names a column that differs between rows; it spreads rows that
    share a frequent value. One shuffle of the rows per ranked column.
    """
    keys = list(keys)
    out = with_pieces(df, keys, list(ranks))
    base = out
    keep = list(df.columns)
    for value, rank in ranks.items():
        piece = f"_piece_{value}"
        sizes = materialize(_piece_sizes(base, keys, value).drop("_least"))
        met = out.join(sizes, [*keys, piece])
        shared = F.col(piece) % 2 == 1
        spread = F.pmod(F.xxhash64(salt or value), F.lit(SALTS))
        w = Window.partitionBy(*keys, piece, "_salt").orderBy(value)
        inside = F.rank().over(w) + (F.count(F.lit(1)).over(w.rangeBetween(0, 0)) - 1) / 2
        placed = F.when(shared, (F.col("_in_piece") + 1) / 2).otherwise(inside)
        keep.append(rank)
        rest = [c for c in out.columns if c.startswith("_piece_") and c != piece]
        out = met.withColumn("_salt", F.when(shared, spread).otherwise(F.lit(0))).withColumn(
            rank, F.col("_before_piece") + placed
        ).select(*keep, *rest)
    return out.select(*keep)


def masked_ranks(
    long: DataFrame, key: str, value: str, seen: str, partners: int, weight: str, out: str = "ranks"
) -> DataFrame:
    """Average rank of every row among the rows of its key that a partner sees, for all partners at once.

    ``seen`` is an array of ``partners`` booleans, ``weight`` the number of equal rows a row stands for.
    Each key is ordered once; running counts per partner take the place of one ordering a pair. Ranks
    are centred on their mean, (rows + 1) / 2, and NULL where the partner does not see the row;
    ``value`` is centred on its weighted mean over all rows of the key. Rows that hold a cut point's own value know
    their rank from the counts of the pieces and take part in no window. The table of pieces, one row
    of two arrays for each key and piece, is bounded by the call and broadcast.
    """
    piece = f"_piece_{value}"
    split = with_pieces(long, [key], [value])
    at = range(partners)
    here = [F.when(F.col(seen)[i], F.col(weight)) for i in at]
    before = Window.partitionBy(key).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(key)

    def known(count: Column) -> Column:
        return F.coalesce(count, F.lit(0))

    sizes = (
        split.groupBy(key, piece)
        .agg(
            F.sum(F.col(weight) * F.col(value)).alias("_total"),
            F.sum(weight).alias("_rows"),
            *[F.sum(h).alias(f"_n{i}") for i, h in enumerate(here)],
        )
        .select(
            key,
            piece,
            (F.sum("_total").over(whole) / F.sum("_rows").over(whole)).alias("_centre"),
            F.array(*[known(F.col(f"_n{i}")) for i in at]).alias("_in_piece"),
            F.array(
                *[known(F.sum(f"_n{i}").over(before)) - (known(F.sum(f"_n{i}").over(whole)) + 1) / 2 for i in at]
            ).alias("_start"),
        )
    )
    met = _meet(split, materialize(sizes, files=1), [key, piece])
    order = Window.partitionBy(key, piece).orderBy(value)
    upto, same = order.rangeBetween(Window.unboundedPreceding, Window.currentRow), order.rangeBetween(0, 0)
    inside = [F.sum(h).over(upto) - (F.sum(h).over(same) - 1) / 2 for h in here]
    shared = [(F.col("_in_piece")[i] + 1) / 2 for i in at]
    rest = [c for c in long.columns if c != value]

    def placed(rows: DataFrame, ranks: list[Column]) -> DataFrame:
        ranked = F.array(*[F.when(F.col(seen)[i], F.col("_start")[i] + r) for i, r in enumerate(ranks)])
        return rows.select(*rest, (F.col(value) - F.col("_centre")).alias(value), ranked.alias(out))

    odd = F.col(piece) % 2 == 1
    return placed(met.filter(~odd), inside).unionByName(placed(met.filter(odd), shared))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, at: Sequence[float]) -> DataFrame:
    """Exact linearly interpolated quantiles per key: columns keys, ``q``, ``quantile``.

    Only the rows of the pieces holding a wanted position are ordered.
    """
    keys = list(keys)
    piece = f"_piece_{value}"
    split = with_pieces(df.filter(F.col(value).isNotNull()).select(*keys, value), keys, [value])
    sizes = _piece_sizes(split, keys, value)
    whole = Window.partitionBy(*keys)
    spots = (
        sizes.withColumn("_rows", F.sum("_in_piece").over(whole))
        .withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in at])))
        .withColumn("_spot", (F.col("_rows") - 1) * F.col("q"))
        .withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("_at", F.when(F.col("_side") == 0, F.floor("_spot")).otherwise(F.ceil("_spot")))
        .filter(
            (F.col("_before_piece") <= F.col("_at"))
            & (F.col("_at") < F.col("_before_piece") + F.col("_in_piece"))
        )
        .select(*keys, piece, "q", "_spot", "_side", (F.col("_at") - F.col("_before_piece") + 1).alias("_nth"), "_least")
    )
    single = spots.filter((F.col(piece) % 2 == 1) | (F.col("_nth") == 1)).select(
        *keys, "q", "_spot", "_side", F.col("_least").alias("_value")
    )
    sought = spots.filter((F.col(piece) % 2 == 0) & (F.col("_nth") > 1)).drop("_least")
    order = Window.partitionBy(*keys, piece).orderBy(value)
    wanted = split.join(F.broadcast(sought.select(*keys, piece).distinct()), [*keys, piece])
    found = (
        wanted.withColumn("_nth", F.row_number().over(order))
        .join(F.broadcast(sought), [*keys, piece, "_nth"])
        .select(*keys, "q", "_spot", "_side", F.col(value).alias("_value"))
    )
    ends = single.unionByName(found).groupBy(*keys, "q").agg(
        F.max("_spot").alias("_spot"),
        F.max(F.when(F.col("_side") == 0, F.col("_value"))).alias("_low"),
        F.max(F.when(F.col("_side") == 1, F.col("_value"))).alias("_high"),
    )
    part = F.col("_spot") - F.floor("_spot")
    return ends.select(
        *keys, "q", (F.col("_low") + (F.col("_high") - F.col("_low")) * part).alias("quantile")
    )


def medians(df: DataFrame, keys: Sequence[str], value: str, out: str = "median") -> DataFrame:
    return quantiles(df, keys, value, [0.5]).select(*keys, F.col("quantile").alias(out))


def ordinals(
    df: DataFrame, keys: Sequence[str], value: str, tie_date: str, tie_key: str, out: str = "ordinal"
) -> DataFrame:
    """1-based position in the total order (value, tie_date, tie_key) within ``keys``.

    Pieces of a single shared value are further cut by date, so the largest
    window holds the ``tie_key`` rows of one value and date.
    """
    keys = list(keys)
    piece = f"_piece_{value}"
    split = with_pieces(df, keys, [value]).withColumn(
        "_day", F.when(F.col(piece) % 2 == 1, F.col(tie_date))
    )
    earlier = Window.partitionBy(*keys).orderBy(piece, "_day").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        split.groupBy(*keys, piece, "_day")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, piece, F.col("_day").alias("_start_day"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    )
    order = Window.partitionBy(*keys, piece, "_day").orderBy(value, tie_date, tie_key)
    right = starts.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col(piece).alias("_r_piece"), "_start_day", "_start")
    match = F.col(piece) == F.col("_r_piece")
    for k in keys:
        match = match & (F.col(k) == F.col(f"_r_{k}"))
    return (
        split.withColumn("_at", F.row_number().over(order))
        .join(right, match & F.col("_day").eqNullSafe(F.col("_start_day")))
        .select(*df.columns, (F.col("_start") + F.col("_at")).alias(out))
    )
