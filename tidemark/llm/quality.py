"""Quality rules by robust multivariate outliers, in DataFrame functions only.

Every text gets counts, and from them a vector of transformed statistics. For each
language and source the minimum-covariance-determinant estimate of centre and
spread is found by concentration steps: from medians and median deviations on,
each step keeps the ``SUPPORT`` share of rows nearest to the present centre and
takes their mean and covariance. To that covariance every text adds what its own
shares of lines and words may vary by, as a share of few is uncertain. Rows whose
Mahalanobis distance from their group is beyond ``CUT`` are rejected; each
statistic suffices for it. Sums are taken over whole numbers and quantiles over
a fixed grid, so no result depends on the order of rows, and no group meets in one
task: each step is a partial aggregate of one small row a text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, SPACES
from tidemark.session import materialize

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Share of a group's rows that a concentration step keeps.
SUPPORT = 0.75
STEPS = 3
#: Groups with fewer rows are judged by their language, and languages by all rows.
LEAST_ROWS = 60
#: Least standard deviation of each statistic: differences below it are no fault.
FLOORS = (0.08, 0.05, 0.08, 0.07, 0.06)
#: Words that one repetition covers at least (two windows of three): repeated words come in such units.
LEAST_COVER = 6
#: Squared distance beyond which a row is rejected: the 0.9999 quantile of chi-square with five degrees of freedom.
CUT = 25.7448
#: Median of chi-square with five degrees of freedom.
MEDIAN_CHI2 = 4.3515
UNIT = 10_000
_STATS = [f"x{i}" for i in range(len(FLOORS))]


def _let(value: Column, body) -> Column:
    """``body(value)`` with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words within 3-word windows that occur twice or more in the same text."""

    def covered(marks: Column) -> Column:
        pairs = F.sort_array(F.transform(marks, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def places(s: Column) -> Column:
            same = F.filter(
                s,
                lambda e, i: ((i > 0) & (F.get(s, i - 1)["h"] == e["h"])) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)),
            )
            order = F.sort_array(F.transform(same, lambda e: e["p"]))
            start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
            step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last"))
            return F.aggregate(order, start, step, lambda a: a["n"])

        return F.when(F.size(F.array_distinct(marks)) == F.size(marks), F.lit(0).cast("long")).otherwise(_let(pairs, places))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_let(windows, covered))


def with_counts(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_upper; null is empty.

    Windows are compared by 64-bit hashes within one text.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(body, SPACE + "+"), "")
    lines = F.filter(F.split(body, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    by_words = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r")))
    by_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    without = lambda chars: F.length(F.translate(body, chars, ""))
    p = prefix
    return (
        docs.withColumn(f"{p}by_words", by_words)
        .withColumn(f"{p}by_lines", by_lines)
        .withColumn(f"{p}word_chars", without(SPACES).cast("long"))
        .withColumn(f"{p}n_symbols", (F.length(body) - without(SYMBOLS)).cast("long"))
        .withColumn(f"{p}n_upper", (F.length(body) - without(UPPER)).cast("long"))
        .withColumn(f"{p}n_words", F.col(f"{p}by_words")["n"])
        .withColumn(f"{p}n_repeat_words", F.col(f"{p}by_words")["r"])
        .withColumn(f"{p}n_lines", F.col(f"{p}by_lines")["n"])
        .withColumn(f"{p}n_dup_lines", F.col(f"{p}by_lines")["d"])
        .drop(f"{p}by_words", f"{p}by_lines")
    )


def base_failed(p: str = "") -> Column:
    return (F.col(f"{p}n_words") < 50) | (100 * F.col(f"{p}n_repeat_words") > 50 * F.col(f"{p}n_words"))


def _vector(p: str = "") -> list[Column]:
    """Transformed statistics as whole multiples of 1 / UNIT; only for texts with words."""
    c = lambda name: F.col(f"{p}{name}").cast("double")
    root = lambda share: F.sqrt(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))
    values = [
        F.log(c("word_chars") / c("n_words")),
        root(c("n_symbols") / c("word_chars")),
        root(c("n_dup_lines") / c("n_lines")),
        F.asin(root(c("n_repeat_words") / c("n_words"))),
        root(c("n_upper") / c("word_chars")),
    ]
    return [F.round(v * UNIT).cast("long").alias(x) for v, x in zip(values, _STATS)]


def _quantile(cells: DataFrame, by: list[str], share: float, out: str) -> DataFrame:
    """Smallest ``cell`` with at least ``share`` of the rows up to it, for each ``by``."""
    counts = cells.groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*by).orderBy("cell")  # a fixed grid: a bounded number of cells
    run = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    return run.where(F.col("upto") >= F.col("all") * share).groupBy(*by).agg(F.min("cell").alias(out))


def _distance(center: str, factor: str) -> Column:
    """Squared distance of the vector, by forward substitution with the Cholesky factor."""
    y: list[Column] = []
    for i, x in enumerate(_STATS):
        rest = F.col(x) / UNIT - F.col(f"{center}{i}")
        for j in range(i):
            rest = rest - F.col(f"{factor}{i}{j}") * y[j]
        y.append(rest / F.col(f"{factor}{i}{i}"))
    return reduce(lambda a, b: a + b, [v * v for v in y])


def _fit(near: DataFrame) -> DataFrame:
    """Mean and Cholesky factor of the covariance, floors added, of each group's rows."""
    k = range(len(_STATS))
    whole = lambda v: F.sum(v.cast("decimal(20,0)"))
    sums = near.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"),
        *[whole(F.col(f"x{i}")).alias(f"s{i}") for i in k],
        *[whole(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in k for j in range(i + 1)],
    )
    number = lambda name: F.col(name).cast("double")
    means = sums.select("group", "n", *[(number(f"s{i}") / F.col("n") / UNIT).alias(f"m{i}") for i in k], *[f"q{i}{j}" for i in k for j in range(i + 1)])
    cov = means.select(
        "group", *[f"m{i}" for i in k],
        *[
            (number(f"q{i}{j}") / F.col("n") / UNIT / UNIT - F.col(f"m{i}") * F.col(f"m{j}") + F.lit(FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}")
            for i in k for j in range(i + 1)
        ],
    )
    out = cov
    for j in k:  # column by column; the floors keep every pivot positive
        pivot = F.col(f"c{j}{j}")
        for t in range(j):
            pivot = pivot - F.col(f"l{j}{t}") * F.col(f"l{j}{t}")
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(pivot, F.lit(FLOORS[j] ** 2))))
        for i in range(j + 1, len(_STATS)):
            value = F.col(f"c{i}{j}")
            for t in range(j):
                value = value - F.col(f"l{i}{t}") * F.col(f"l{j}{t}")
            out = out.withColumn(f"l{i}{j}", value / F.col(f"l{j}{j}"))
    return out.select("group", *[f"m{i}" for i in k], *[f"l{i}{j}" for i in k for j in range(i + 1)])


def _cell(squared: Column) -> Column:
    return F.floor(F.log1p(F.least(squared, F.lit(1e12))) * 200).alias("cell")


def estimates(vectors: DataFrame) -> DataFrame:
    """One row a group: centre m*, factor l*, ``scale`` of squared distances, ``rows``.

    ``vectors`` has lang, source and x0...x4. A row counts for its language and
    source, for its language, and for all: struct(lang, source, level).
    """
    level = lambda lang, source, n: F.struct(lang.alias("lang"), source.alias("source"), F.lit(n).alias("level"))
    none = F.lit(None).cast("string")
    groups = F.array(level(F.col("lang"), F.col("source"), 0), level(F.col("lang"), none, 1), level(none, none, 2))
    rows = vectors.select(F.explode(groups).alias("key"), *_STATS).withColumn("group", F.to_json("key")).drop("key")
    cells = rows.select("group", F.posexplode(F.array(*[F.floor(F.col(x) / 50) for x in _STATS])).alias("stat", "cell"))
    middle = _quantile(cells, ["group", "stat"], 0.5, "middle")
    centre = materialize(middle.groupBy("group").pivot("stat", list(range(len(_STATS)))).agg(F.first("middle")).select(
        "group", *[((F.col(str(i)) + 0.5) * 50 / UNIT).alias(f"m{i}") for i in range(len(_STATS))]
    ), files=1)
    met = rows.join(centre, "group")
    spread = met.select("group", F.posexplode(F.array(*[F.floor(F.abs(F.col(x) - F.col(f"m{i}") * UNIT) / 25) for i, x in enumerate(_STATS)])).alias("stat", "cell"))
    mad = _quantile(spread, ["group", "stat"], 0.5, "middle").groupBy("group").pivot("stat", list(range(len(_STATS)))).agg(F.first("middle"))
    k = range(len(_STATS))
    start = centre.join(mad, "group").select(
        "group", *[f"m{i}" for i in k],
        *[
            (F.greatest((F.col(str(i)) + 0.5) * 25 / UNIT * 1.4826, F.lit(FLOORS[i])) if i == j else F.lit(0.0)).alias(f"l{i}{j}")
            for i in k for j in range(i + 1)
        ],
    )
    fit = materialize(start, files=1)
    for _ in range(STEPS):
        placed = rows.join(fit, "group").withColumn("d", _distance("m", "l"))
        cut = materialize(_quantile(placed.select("group", _cell(F.col("d"))), ["group"], SUPPORT, "edge"), files=1)
        near = placed.join(cut, "group").where(_cell(F.col("d")) <= F.col("edge"))
        fit = materialize(_fit(near), files=1)
    placed = rows.join(fit, "group").select("group", _cell(_distance("m", "l")))
    middle = _quantile(placed, ["group"], 0.5, "edge").join(placed.groupBy("group").agg(F.count(F.lit(1)).alias("rows")), "group")
    scaled = middle.select(F.col("group").alias("of"), "rows", F.greatest(F.expm1((F.col("edge") + 0.5) / 200) / MEDIAN_CHI2, F.lit(1.0)).alias("scale"))
    return materialize(fit.join(scaled, fit["group"] == scaled["of"]).drop("of"), files=1)


def _inverse_column(s: int) -> list[Column]:
    """Column ``s`` of the inverse of a fit's Cholesky factor."""
    out: list[Column] = []
    for i in range(len(_STATS)):
        rest = F.lit(1.0 if i == s else 0.0)
        for j in range(s, i):
            rest = rest - F.col(f"l{i}{j}") * out[j]
        out.append(rest / F.col(f"l{i}{i}"))
    return out


def _noise_terms(fits: DataFrame) -> DataFrame:
    """``fits`` with a* and b*, columns 2 and 3 of the inverse factor, and their products aa, ab and bb."""
    k = range(len(_STATS))
    some = fits.select("*", *[x.alias(f"a{i}") for i, x in enumerate(_inverse_column(2))], *[x.alias(f"b{i}") for i, x in enumerate(_inverse_column(3))])
    dot = lambda x, y: reduce(lambda a, b: a + b, [F.col(f"{x}{i}") * F.col(f"{y}{i}") for i in k]).alias(x + y)
    return some.select("*", dot("a", "a"), dot("a", "b"), dot("b", "b"))


def _reduced_distance(fit: Column, p: str) -> Column:
    """Squared distance of a row from its ``fit``, less what its own shares may vary by.

    Every step is bound to its value: as columns, a filter on the verdict would take
    each step in place of its name, again and again, to more code than Java compiles.
    """
    vector = _vector(p)

    def solved(y: list[Column]) -> Column:
        i = len(y)
        if i == len(_STATS):
            return reduced(y)
        rest = vector[i] / UNIT - fit[f"m{i}"]
        for j in range(i):
            rest = rest - fit[f"l{i}{j}"] * y[j]
        return _let(rest / fit[f"l{i}{i}"], lambda v: solved([*y, v]))

    def reduced(y: list[Column]) -> Column:
        scale = fit["scale"]
        plain = reduce(lambda a, b: a + b, [v * v for v in y]) / scale
        # a square root or arc sine of a share of n has variance 1 / 4n: added to the covariance by Woodbury's formula
        moved = lambda of: reduce(lambda a, b: a + b, [fit[f"{of}{i}"] * v for i, v in enumerate(y)]) / scale
        uu = 4.0 * F.col(f"{p}n_lines") + fit["aa"] / scale
        ww = 4.0 / LEAST_COVER * F.col(f"{p}n_words") + fit["bb"] / scale
        return _let(
            F.struct(moved("a").alias("u"), moved("b").alias("w"), uu.alias("uu"), (fit["ab"] / scale).alias("uw"), ww.alias("ww")),
            lambda t: plain - (t["ww"] * t["u"] * t["u"] - 2.0 * t["uw"] * t["u"] * t["w"] + t["uu"] * t["w"] * t["w"]) / (t["uu"] * t["ww"] - t["uw"] * t["uw"]),
        )

    return solved([])


def _judged(counted: DataFrame, p: str, lang: str, source: str) -> DataFrame:
    """``counted`` with {p}base_failed, {p}distance and {p}kept."""
    failed = counted.withColumn(f"{p}base_failed", base_failed(p))
    good = failed.where(~F.col(f"{p}base_failed"))
    fits = materialize(_noise_terms(estimates(good.select(F.col(lang).alias("lang"), F.col(source).alias("source"), *_vector(p)))), files=1)
    level = F.get_json_object("group", "$.level")
    table = {}
    for n in range(3):
        params = F.struct(*[c for c in fits.columns if c not in {"group", "rows"}])
        some = fits.where(level == n).where(F.col("rows") >= (LEAST_ROWS if n < 2 else 0))
        table[n] = some.select(F.get_json_object("group", "$.lang").alias(f"{p}lang{n}"), F.get_json_object("group", "$.source").alias(f"{p}source{n}"), params.alias(f"{p}fit{n}"))
    out = failed.join(table[0], F.col(lang).eqNullSafe(F.col(f"{p}lang0")) & F.col(source).eqNullSafe(F.col(f"{p}source0")), "left")
    out = out.join(table[1].drop(f"{p}source1"), F.col(lang).eqNullSafe(F.col(f"{p}lang1")), "left")
    whole = table[2].first()  # one row: the estimate over all
    last = F.lit(None) if whole is None else F.struct(*[F.lit(v).alias(f) for f, v in whole[f"{p}fit2"].asDict().items()])
    fit = F.coalesce(f"{p}fit0", f"{p}fit1", last) if whole is not None else F.col(f"{p}fit0")
    out = out.withColumn(f"{p}fit", fit)
    out = out.withColumn(f"{p}distance", F.when(~F.col(f"{p}base_failed"), _let(F.col(f"{p}fit"), lambda f: _reduced_distance(f, p))))
    out = out.withColumn(f"{p}kept", ~F.col(f"{p}base_failed") & (F.coalesce(F.col(f"{p}distance"), F.lit(0.0)) <= CUT))
    helpers = [c for c in out.columns if c.startswith(p) and c[len(p):].rstrip("0123456789") in {"lang", "source", "fit"} and c not in counted.columns]
    return out.drop(*helpers)


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(id, counts, base_failed, distance, kept) for every row.

    Null and empty texts fail the base rule. Null languages and sources are groups
    of their own. Repeated rows are judged alike. distance is null where the base
    rule fails. An empty table gives an empty result.
    """
    few = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("of_lang"), F.col(source).cast("string").alias("of_source"))
    counted = materialize(with_counts(few).drop("text"))
    return _judged(counted, "", "of_lang", "of_source")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows of ``docs`` that pass, with its columns."""
    counted = materialize(with_counts(docs, text, "__q_"))
    return _judged(counted, "__q_", lang, source).where("__q_kept").select(docs.columns)
