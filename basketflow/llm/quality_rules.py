"""Quality rules: robust multivariate outliers for each language and source, in SQL only."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketflow.llm.common import fresh, saved

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30  # per cent of the words
#: Groups of fewer documents are pooled: over the sources of their language, then over all.
MIN_GROUP = 200
#: Share of a group that the covariance of least determinant is sought in.
SUPPORT = 0.75
STEPS = 5
#: Squared distance over which a document is rejected.
CUTOFF = 48.0
#: Cells for which estimates are still sent to every executor (a few hundred bytes each).
MAX_BROADCAST = 50_000

#: The statistics vector: SQL over the counts, and the least standard deviation it is given.
#: Without the latter a statistic that nearly all clean texts share would reject the rest.
FEATURES = {
    "words": ("ln(n_words + 1)", 0.5),
    "word_length": ("ln((word_chars + 1) / (n_words + 1))", 0.1),
    "symbols": ("ln(1 + 20 * n_symbols / (n_words + 1))", 0.3),
    "dup_lines": ("n_dup_lines / (n_lines + 2)", 0.06),
    "repeats": ("n_repeat_words / (n_words + 1)", 0.05),
    "capitals": ("n_capitals / (word_chars + 1)", 0.03),
    "shouts": ("ln(1 + 20 * n_shouts / (n_words + 1))", 0.3),
}
_P = len(FEATURES)
#: Median and 97.5 % point of chi square with as many degrees of freedom as
#: there are features.
CHI_MEDIAN, CHI_975 = 6.346, 16.013
#: Squared distances are counted in classes of this many to a natural logarithm.
_CLASSES = 8

_SPACE = r"[\\x20\\x09-\\x0D]"


def _pick(array: str, body: str, name: str) -> str:
    """SQL that computes ``array`` once and calls it ``name`` in ``body``."""
    return f"transform(array({array}), {name} -> {body})[0]"


def _covered_words() -> str:
    """SQL: how many words are in windows of ``WINDOW`` words that occur twice or more.

    Windows are compared by a 64-bit hash. Texts without a repeated window, which are nearly
    all, end with one set of hashes; the others sort (hash, position) pairs within the row.
    """
    hashes = f"transform(sequence(0, n_words - {WINDOW}), i -> xxhash64(slice(w, cast(i AS int) + 1, {WINDOW})))"
    order = "sort_array(transform(hs, (h, i) -> named_struct('h', h, 'i', i)))"
    twice = "s.h <=> get(o, k - 1).h OR s.h <=> get(o, k + 1).h"
    marked = f"transform(o, (s, k) -> if({twice}, s.i, -1))"
    places = _pick(order, f"sort_array(filter({marked}, x -> x >= 0))", "o")
    steps = f"transform(p, (x, k) -> least({WINDOW}, coalesce(get(p, k + 1) - x, {WINDOW})))"
    total = _pick(places, f"aggregate({steps}, 0, (a, b) -> a + b)", "p")
    counted = _pick(hashes, f"if(size(array_distinct(hs)) = size(hs), 0, {total})", "hs")
    return f"cast(if(n_words < {WINDOW}, 0, {counted}) AS long)"


def quality_statistics(docs: DataFrame, keep: dict[str, str], text_col: str = "text") -> DataFrame:
    """Counts of each row's text, beside the columns of ``keep`` (new name -> old name).

    Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals,
    n_shouts, base_failed``. One pass, nothing is shuffled. Null texts have no words. A very
    long text is held, with its words, by one task.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).alias("t")
    split = docs.select(*[F.col(old).alias(new) for new, old in keep.items()], text).selectExpr(
        *keep, "t", f"array_remove(split(t, '{_SPACE}+'), '') AS w",
        f"filter(split(t, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]') AS ls",
    )
    counted = split.selectExpr(
        *keep, "w",
        "cast(size(w) AS long) AS n_words",
        "cast(length(array_join(w, '')) AS long) AS word_chars",
        "cast(regexp_count(t, '[#*$%&|<>]') AS long) AS n_symbols",
        "cast(size(ls) AS long) AS n_lines",
        "cast(size(ls) - size(array_distinct(ls)) AS long) AS n_dup_lines",
        "cast(length(t) - length(regexp_replace(t, '\\\\p{Lu}+', '')) AS long) AS n_capitals",
        "cast(regexp_count(t, '[!?]') AS long) AS n_shouts",
    )
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_shouts"]
    return counted.withColumn("n_repeat_words", F.expr(_covered_words())).selectExpr(
        *keep, *names,
        f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed",
    )


def _vector() -> Column:
    return F.array(*[F.expr(f"cast({sql} AS double)") for sql, _ in FEATURES.values()])


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(_P) for j in range(i + 1)]


def _moments() -> list[Column]:
    """Sums from which mean and covariance of any union of parts follow."""
    first = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(_P)]
    second = [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"q{i}_{j}") for i, j in _pairs()]
    return [F.count("*").alias("n"), *first, *second]


def _whitening(sums: DataFrame) -> DataFrame:
    """Moments -> mean ``m``, ``p`` (rows of the inverse Cholesky factor) and log determinant.

    ``sums`` has the moments of one estimate in each row; ``p`` turns a centred vector into
    one whose squared length is the squared Mahalanobis distance.
    """
    floors = [floor for _, floor in FEATURES.values()]
    c = {
        f"c{i}_{j}": F.col(f"q{i}_{j}") / F.col("n") - F.col(f"s{i}") * F.col(f"s{j}") / (F.col("n") * F.col("n"))
        for i, j in _pairs()
    }
    for i, floor in enumerate(floors):
        c[f"c{i}_{i}"] = c[f"c{i}_{i}"] + F.lit(floor * floor)
    frame = sums.withColumns(c)
    for j in range(_P):  # Cholesky, column by column
        square = sum((F.col(f"l{j}_{k}") * F.col(f"l{j}_{k}") for k in range(j)), F.lit(0.0))
        frame = frame.withColumn(
            f"l{j}_{j}", F.sqrt(F.greatest(F.col(f"c{j}_{j}") - square, F.lit((floors[j] / 10) ** 2)))
        )
        below = {}
        for i in range(j + 1, _P):
            dot = sum((F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)), F.lit(0.0))
            below[f"l{i}_{j}"] = (F.col(f"c{i}_{j}") - dot) / F.col(f"l{j}_{j}")
        if below:
            frame = frame.withColumns(below)
    frame = frame.withColumns({f"p{i}_{i}": 1 / F.col(f"l{i}_{i}") for i in range(_P)})
    for gap in range(1, _P):  # its inverse, diagonal by diagonal
        step = {}
        for j in range(_P - gap):
            i = j + gap
            dot = sum((F.col(f"l{i}_{k}") * F.col(f"p{k}_{j}") for k in range(j, i)), F.lit(0.0))
            step[f"p{i}_{j}"] = -dot / F.col(f"l{i}_{i}")
        frame = frame.withColumns(step)
    keys = [k for k in ("grp", "start") if k in sums.columns]
    return frame.select(
        *keys,
        F.array(*[F.col(f"s{i}") / F.col("n") for i in range(_P)]).alias("m"),
        F.array(*[F.col(f"p{i}_{j}") for i, j in _pairs()]).alias("p"),
        sum((F.log(f"l{i}_{i}") for i in range(_P)), F.lit(0.0)).alias("log_det"),
    )


def _distance() -> Column:
    """Squared Mahalanobis distance of ``x`` under ``m`` and ``p``."""
    at = {pair: n for n, pair in enumerate(_pairs())}
    rows = [
        sum((F.col("p")[at[i, j]] * (F.col("x")[j] - F.col("m")[j]) for j in range(i + 1)), F.lit(0.0))
        for i in range(_P)
    ]
    return sum((F.pow(r, F.lit(2.0)) for r in rows), F.lit(0.0))


def _spread(small: DataFrame) -> DataFrame:
    """Sent to every executor if it has few rows; if not, the join decides how."""
    return F.broadcast(small) if small.count() <= MAX_BROADCAST else small


def _groups(stats: DataFrame) -> DataFrame:
    """The group of each (lang, source): itself, its language's pool, or the pool of all."""
    cells = stats.groupBy("lang", "source").count()
    small = F.when(F.col("count") < MIN_GROUP, F.col("count")).otherwise(0)
    by_lang = F.sum(small).over(Window.partitionBy("lang"))
    lang = F.coalesce("lang", F.lit("?"))
    return cells.select(
        "lang", "source",
        F.when(F.col("count") >= MIN_GROUP, F.concat_ws("\t", F.lit("source"), lang, F.coalesce("source", F.lit("?"))))
        .when(by_lang >= MIN_GROUP, F.concat_ws("\t", F.lit("lang"), lang))
        .otherwise(F.lit("all"))
        .alias("grp"),
    )


def _subset(members: DataFrame, estimates: DataFrame, share: float | None) -> DataFrame:
    """Moments of the rows that are nearest under each estimate.

    Rows are counted in classes of their distance, with the moments of each class, so that
    one aggregation gives both the quantile and the moments up to it. ``share`` None takes
    the rows within the 97.5 % point of a normal distribution.
    """
    keys = ["grp", "start"]
    level = F.floor(F.log(F.greatest(_distance(), F.lit(1e-6))) * _CLASSES).alias("level")
    far = members.join(_spread(estimates), "grp").select("grp", "start", "x", level)
    classes = far.groupBy(*keys, "level").agg(*_moments())
    if share is None:
        scale = F.greatest(
            F.lit(1.0),
            F.exp(F.min(F.when(F.col("upto") * 2 >= F.col("all"), F.col("level"))).over(Window.partitionBy(*keys)) / _CLASSES) / CHI_MEDIAN,
        )
        near = F.exp(F.col("level") / _CLASSES) <= CHI_975 * scale
    else:
        near = F.col("upto") - F.col("n") < F.ceil(F.col("all") * share)
    upto = Window.partitionBy(*keys).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    ranked = classes.withColumn("upto", F.sum("n").over(upto)).withColumn(
        "all", F.sum("n").over(Window.partitionBy(*keys))
    )
    sums = ["n", *[f"s{i}" for i in range(_P)], *[f"q{i}_{j}" for i, j in _pairs()]]
    return ranked.withColumn("near", near).where("near").groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])


def fit_outliers(stats: DataFrame) -> DataFrame:
    """``lang, source, m, p``: the robust estimate to hold each cell's documents against.

    Only rows that pass the base rules take part. Two starts are refined: the whole group, and
    the group's medians with the floors as scales. Each step takes the ``SUPPORT`` share of
    rows nearest to the last estimate (a concentration step, which never raises the
    determinant); the start with the smaller determinant wins and is reweighted once over all
    rows within the 97.5 % point. The estimates grow with the number of cells only.
    """
    cells = saved(_groups(stats.where("NOT base_failed")), "cells")
    on = F.expr("c.lang <=> r.lang AND c.source <=> r.source")
    members = saved(
        stats.where("NOT base_failed").select("lang", "source", _vector().alias("x")).alias("r")
        .join(_spread(cells).alias("c"), on).select("grp", "x"),
        "members",
    )
    whole = _whitening(members.groupBy("grp").agg(*_moments()).withColumn("start", F.lit(0)))
    middle = members.groupBy("grp").agg(
        F.array(*[F.percentile_approx(F.col("x")[i], 0.5, 1000) for i in range(_P)]).alias("m")
    ).select(
        "grp", F.lit(1).alias("start"), "m",
        F.array(*[F.lit(1 / list(FEATURES.values())[i][1] if i == j else 0.0) for i, j in _pairs()]).alias("p"),
        F.lit(0.0).alias("log_det"),
    )
    estimates = saved(whole.unionByName(middle), "estimates")
    for _ in range(STEPS):
        estimates = saved(_whitening(_subset(members, estimates, SUPPORT)), "estimates")
    best = Window.partitionBy("grp").orderBy("log_det", "start")
    chosen = saved(estimates.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth"), "estimates")
    final = _whitening(_subset(members, chosen, None))
    sizes = members.groupBy("grp").count().where(F.col("count") >= MIN_GROUP).select("grp")
    return saved(cells.join(final.join(sizes, "grp"), "grp").select("lang", "source", "m", "p"), "estimates")


def judge(stats: DataFrame, estimates: DataFrame) -> DataFrame:
    """``stats`` with ``distance`` (null without an estimate) and ``kept``."""
    on = F.expr("e.lang <=> r.lang AND e.source <=> r.source")
    return (
        stats.withColumn("x", _vector()).alias("r")
        .join(_spread(estimates).alias("e"), on, "left")
        .select("r.*", "m", "p")
        .withColumn("distance", _distance())
        .withColumn("kept", F.expr(f"NOT base_failed AND coalesce(distance <= {CUTOFF}, true)"))
        .drop("x", "m", "p")
    )


def quality_verdicts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """Statistics and verdict of every row.

    Returns ``doc_id, lang, source``, the counts of :func:`quality_statistics`, ``distance``
    and ``kept``. A row is kept if it passes the base rules and its vector is no outlier of
    its group.

    Null languages and sources are groups of their own. A null, empty or blank text fails the
    base rules. Repeated rows and ids are kept and count each time. Groups that are small
    even when pooled have no estimate and keep what passes the base rules. An empty table
    gives an empty result. Other columns are not read.
    """
    stats = saved(
        quality_statistics(docs, {"doc_id": id_col, "lang": lang_col, "source": source_col}, text_col), "statistics"
    )
    return judge(stats, fit_outliers(stats))


def quality_filter(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """The rows that :func:`quality_verdicts` keeps, with all their columns.

    The rows are written once beside their statistics, so that neither is computed twice and
    the texts need not be joined to the verdicts.
    """
    (row,) = fresh(docs, "row")
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row),
        *[F.col(c) for c in {lang_col, source_col, text_col}],
    )
    names = {"lang": lang_col, "source": source_col}
    stats = saved(quality_statistics(whole, {row: row, **names}, text_col), "statistics")
    return judge(stats, fit_outliers(stats)).where("kept").select(f"{row}.*")
