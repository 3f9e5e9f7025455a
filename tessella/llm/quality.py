"""Quality rules: text statistics, then robust multivariate outliers by language and source.

DataFrame expressions only. Each text's statistics are one expression over its words, written once.
The vector (log mean word length, roots of symbols, repeated lines and repeated words a word) gets a
minimum-covariance-determinant estimate for each language and source, each language and all rows:

* three deterministic starts: medians and MADs alone, the correlations of tanh-squeezed rows, and the
  covariance of spatial signs, each scaled by the MADs;
* ``STEPS`` concentration steps of each re-estimate mean and covariance from the ``SHARE`` of rows with
  the smallest Mahalanobis distance; the start with the smallest determinant goes on for as many more;
* the covariance is scaled so that the median distance is that of a normal sample, never down.

A group's estimate is then shrunk towards its language's, and that towards the one over all rows, with
the weight n / (n + ``PRIOR``): small groups lean on their parents without a step at any size. A text
whose squared distance passes ``CUTOFF`` is rejected.

Scale: groups are only ever aggregated (partial sums and quantile sketches), never collected; each pass
reads the written statistics, five numbers a text, and shuffles partial aggregates. Verdicts are a lookup
of the group's estimate, a table of one row a group that Spark broadcasts while it is small, so rows are
never shuffled for it. ``FLOOR`` is the smallest scale in which a statistic counts as spread, so constant
statistics neither divide by zero nor reject clean texts. Each is small enough for its statistic alone to
pass ``CUTOFF`` within the base rules (repeated words over about a third of a text do), and large enough
for one repeated line in a short text not to.

Edge cases: null and empty texts have no words and fail the base rules; null language or source is a
group of its own; texts shorter than a window have no repeated words; repeated rows each keep their
verdict; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE_CLASS, store

SHARE, STEPS, STARTS, PRIOR = 0.75, 2, 3, 50
#: Entries of a quantile sketch; ranks are off by 1 / ACCURACY at most.
ACCURACY = 500
#: Four degrees of freedom: the median of chi-squared, and its quantile for one in a million.
MEDIAN_CHI2, CUTOFF = 3.3567, 33.38
FLOOR = [0.06, 0.06, 0.06, 0.1]
P = len(FLOOR)
#: Variance of tanh of a standard normal number.
TANH_VAR = 0.394
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once however often the body names it."""
    return F.transform(F.array(value), body).getItem(0)


def _repeat_words(words: Column) -> Column:
    """Words covered by windows of three that stand in the text at least twice.

    Windows are sorted as numbers: high bits hash the words, low bits hold the place (as many as the
    text needs), so equal windows become neighbours. Where the high bits agree the words are compared,
    with the second neighbour too, for a collision may stand between equal windows.
    """
    windows = F.size(words) - 2

    def counted(low: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), low) - 1
        key = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        numbers = F.sort_array(F.transform(F.sequence(F.lit(0), windows - 1), lambda i: key(i).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))

        def covered(keys: Column) -> Column:
            high = lambda x: F.call_function("shiftright", x, low)
            word = lambda x, k: F.get(words, x.bitwiseAND(mask).cast("int") + k)
            same = lambda x, y: (high(x) == high(y)) & (word(x, 0) == word(y, 0)) & (word(x, 1) == word(y, 1)) & (word(x, 2) == word(y, 2))
            equal = lambda x, j: F.coalesce(same(x, F.get(keys, j)), F.lit(False))
            again = F.filter(keys, lambda x, j: equal(x, j - 1) | equal(x, j + 1) | equal(x, j - 2) | equal(x, j + 2))
            places = F.sort_array(F.transform(again, lambda x: x.bitwiseAND(mask)))
            gaps = lambda p: F.transform(p, lambda x, j: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, j + 1) - x, F.lit(3).cast("long"))))
            return F.aggregate(_let(places, gaps), F.lit(0).cast("long"), lambda a, x: a + x)

        return _let(numbers, covered)

    bits = F.ceil(F.log2(windows + 1)).cast("int")
    return F.when(windows < 2, F.lit(0).cast("long")).otherwise(_let(bits, counted))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source, the base statistics and base_failed of every whole text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = _let(
        F.array_remove(F.split("text", SPACE_CLASS), ""),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            _let(F.array_join(w, ""), lambda t: F.struct(F.length(t).cast("long").alias("chars"), F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("symbols"))).alias("t"),
            _repeat_words(w).alias("repeats"),
        ),
    )
    out = base.select(
        "doc_id", "lang", "source", of_words.alias("w"), _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")
    ).select(
        "doc_id", "lang", "source", F.col("w.n_words").alias("n_words"), F.col("w.t.chars").alias("word_chars"), F.col("w.t.symbols").alias("n_symbols"), "n_dup_lines", F.col("w.repeats").alias("n_repeat_words")
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), F.sqrt(F.col("n_symbols") / n), F.sqrt(F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n)]


def _group_names() -> list[Column]:
    return [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null")) for c in ("lang", "source")]


def _grouped(rows: DataFrame, starts: int) -> DataFrame:
    """Each row for its group, its language and all rows, once a start: columns g (level, a, b, start), x0.. ."""
    lang, source = _group_names()
    key = lambda level, a, b, k: F.struct(F.lit(level).alias("level"), a.alias("a"), b.alias("b"), F.lit(k).alias("start"))
    keys = [key(*names, k) for names in (("own", lang, source), ("lang", lang, F.lit("")), ("all", F.lit(""), F.lit(""))) for k in range(starts)]
    return rows.select(*(f"x{i}" for i in range(P)), F.explode(F.array(*keys)).alias("g"))


def _distance() -> Column:
    """Squared Mahalanobis distance from the group's mean m0.. and inverse factor r00, r10, r11, .. ."""
    return sum((sum((F.col(f"r{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0)) ** 2 for i in range(P)), F.lit(0.0))


def _factor(moments: DataFrame) -> DataFrame:
    """From m0.. and c00, c10, c11, .. plus floors: the inverse Cholesky factor r00.. and the log determinant ``det``."""
    df = moments
    for i in range(P):
        df = df.withColumn(f"c{i}{i}", F.greatest(F.col(f"c{i}{i}"), F.lit(0.0)))
    for i, j in PAIRS:
        rest = F.col(f"c{i}{j}") + F.lit(FLOOR[i] ** 2 if i == j else 0.0) - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOOR[i] ** 2 / 4))) if i == j else rest / F.col(f"l{j}{j}"))
    for i in range(P):
        df = df.withColumn(f"r{i}{i}", 1 / F.col(f"l{i}{i}"))
        for j in range(i):
            df = df.withColumn(f"r{i}{j}", -sum((F.col(f"l{i}{k}") * F.col(f"r{k}{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l{i}{i}"))
    df = df.withColumn("det", 2 * sum((F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0)))
    return df.drop(*(f"l{i}{j}" for i, j in PAIRS))


def _starts(rows: DataFrame) -> DataFrame:
    """Each group's medians as the first centre, and the scatter of each start."""
    centre, _ = store(rows.groupBy("g").agg(*(F.percentile_approx(f"x{i}", 0.5, ACCURACY).alias(f"m{i}") for i in range(P))), "centre")
    about = rows.join(centre, "g").groupBy("g")
    spread, _ = store(about.agg(*(F.first(f"m{i}").alias(f"m{i}") for i in range(P)), *((1.4826 * F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, ACCURACY)).alias(f"s{i}") for i in range(P))), "spread")
    z = [(F.col(f"x{i}") - F.col(f"m{i}")) / F.greatest(F.col(f"s{i}"), F.lit(FLOOR[i])) for i in range(P)]
    norm = F.greatest(sum((v * v for v in z), F.lit(0.0)), F.lit(1e-12))
    start = F.col("g.start")
    kernel = lambda i, j: F.when(start == 0, F.lit(float(i == j))).when(start == 1, F.tanh(z[i]) * F.tanh(z[j]) / TANH_VAR).otherwise(P * z[i] * z[j] / norm)
    scatter = rows.join(spread, "g").groupBy("g").agg(
        *(F.first(f"m{i}").alias(f"m{i}") for i in range(P)), *((F.avg(kernel(i, j)) * F.first(f"s{i}") * F.first(f"s{j}")).alias(f"c{i}{j}") for i, j in PAIRS)
    )
    return store(_factor(scatter), "start")[0]


def _concentrate(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """One concentration step: moments of the ``SHARE`` of rows nearest to the estimate."""
    far = rows.join(estimate.drop(*(f"c{i}{j}" for i, j in PAIRS), "det", "n"), "g").withColumn("d", _distance())
    limit, _ = store(far.groupBy("g").agg(F.percentile_approx("d", SHARE, ACCURACY).alias("limit")), "limit")
    near = far.join(limit, "g")
    # sums about the current centre, which is close to the new one: no cancellation
    inside = F.col("d") <= F.col("limit")
    y = [F.when(inside, F.col(f"x{i}") - F.col(f"m{i}")) for i in range(P)]
    sums = near.groupBy("g").agg(
        F.count("*").alias("n"), *(F.first(f"m{i}").alias(f"o{i}") for i in range(P)), *(F.avg(y[i]).alias(f"y{i}") for i in range(P)), *(F.avg(y[i] * y[j]).alias(f"q{i}{j}") for i, j in PAIRS)
    )
    moments = sums.select("g", "n", *((F.col(f"o{i}") + F.col(f"y{i}")).alias(f"m{i}") for i in range(P)), *((F.col(f"q{i}{j}") - F.col(f"y{i}") * F.col(f"y{j}")).alias(f"c{i}{j}") for i, j in PAIRS))
    return store(_factor(moments), "estimate")[0]


def covariance_estimates(rows: DataFrame) -> DataFrame:
    """g, n, mean, covariance and log determinant of every group, language and of all rows."""
    several, single = _grouped(rows, STARTS), _grouped(rows, 1)
    estimate = _starts(several)
    for _ in range(STEPS):
        estimate = _concentrate(several, estimate)
    group = F.struct("g.level", "g.a", "g.b", F.lit(0).alias("start"))
    rest = F.struct(*(c for c in estimate.columns if c != "g"))
    best = estimate.groupBy(group.alias("g")).agg(F.min_by(rest, F.struct("det", "g.start")).alias("e")).select("g", "e.*")
    for _ in range(STEPS):
        best = _concentrate(single, best)
    middle = single.join(best, "g").groupBy("g").agg(F.percentile_approx(_distance(), 0.5, ACCURACY).alias("middle"))
    scale = F.greatest(F.lit(1.0), F.col("middle") / MEDIAN_CHI2)
    # the floors scale along: they are added again where the factor is made
    widened = lambda i, j: F.col(f"c{i}{j}") * F.col("scale") + (F.lit(FLOOR[i] ** 2) * (F.col("scale") - 1) if i == j else F.lit(0.0))
    found = best.join(middle, "g").withColumn("scale", scale)
    return found.select("g", "n", *(f"m{i}" for i in range(P)), *(widened(i, j).alias(f"c{i}{j}") for i, j in PAIRS), "det")


def _shrunk(own: DataFrame, parent: DataFrame, on: list[str]) -> DataFrame:
    """``own`` moments as a mixture with their parent's; see the module."""
    up = parent.select(*on, *(F.col(c).alias(f"up_{c}") for c in [*(f"m{i}" for i in range(P)), *(f"c{i}{j}" for i, j in PAIRS)]))
    both = own.join(up, on).withColumn("w", F.col("n") / (F.col("n") + PRIOR))
    w, v = F.col("w"), 1 - F.col("w")
    gap = [F.col(f"m{i}") - F.col(f"up_m{i}") for i in range(P)]
    keep = [c for c in own.columns if c in ("a", "b", "n")]
    return both.select(*keep, *((w * F.col(f"m{i}") + v * F.col(f"up_m{i}")).alias(f"m{i}") for i in range(P)), *((w * F.col(f"c{i}{j}") + v * F.col(f"up_c{i}{j}") + w * v * gap[i] * gap[j]).alias(f"c{i}{j}") for i, j in PAIRS))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, the base statistics, base_failed, the squared robust distance and kept."""
    found, _ = store(text_statistics(docs, id_col, text_col, lang_col, source_col), "statistics")
    names = [f"x{i}" for i in range(P)]
    vectors = [F.coalesce(v, F.lit(0.0)).alias(x) for v, x in zip(_vector(), names)]
    raw, _ = store(covariance_estimates(found.filter("not base_failed").select("lang", "source", *vectors)), "estimates")
    level = lambda name, *keys: raw.filter(F.col("g.level") == name).select(*(f"g.{k}" for k in keys), F.lit(0).alias("every"), "n", *(f"m{i}" for i in range(P)), *(f"c{i}{j}" for i, j in PAIRS))
    languages = _shrunk(level("lang", "a"), level("all"), ["every"])
    final, _ = store(_factor(_shrunk(level("own", "a", "b"), languages, ["a"])), "final")
    lang, source = _group_names()
    judged = found.select("*", *vectors, lang.alias("a"), source.alias("b")).join(final.drop("n"), ["a", "b"], "left").withColumn("squared_distance", F.when(~F.col("base_failed"), _distance()))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce("squared_distance", F.lit(0.0)) <= CUTOFF)).alias("kept"), "squared_distance",
    )
