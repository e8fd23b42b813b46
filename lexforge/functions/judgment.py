"""Statistics of judgment distributions: arrays of probabilities over k ordered labels, all in the JVM.

The labels' values run evenly from 0 to 1 unless a support is given as an array of the same length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import column


def grid(p: Column | str) -> Column:
    """k even steps from 0 to 1."""
    k = F.size(column(p))
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.when(k > 1, i / F.greatest(k - 1, F.lit(1))).otherwise(F.lit(0.0)))


def centred(p: Column | str) -> Column:
    """k whole steps from k // 2 down to -(k // 2)."""
    k = F.size(column(p))
    half = F.floor(k / 2)
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: (half - i).cast("double"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def running(p: Column | str) -> Column:
    """Prefix sums."""
    a = column(p)
    return F.transform(a, lambda _, i: total(F.slice(a, 1, i + 1)))


def mode(p: Column | str, *, support: Column | None = None, split_ties: bool = False) -> Column:
    """The value of the first most likely label, or the mean of the values of all."""
    a, s = column(p), support if support is not None else grid(p)
    top = F.array_max(a)
    if not split_ties:
        return F.get(s, F.array_position(a, top).cast("int") - 1)
    hits = F.transform(a, lambda x: F.when(x == top, F.lit(1.0)).otherwise(F.lit(0.0)))
    return dot(s, hits) / total(hits)


def mean(p: Column | str, support: Column | None = None) -> Column:
    return dot(support if support is not None else grid(p), column(p))


def rounded_mean(p: Column | str) -> Column:
    """The mean on the labels' grid, halves to the even label."""
    steps = F.size(column(p)) - 1
    return F.bround(mean(p) * steps) / steps


def quantile(p: Column | str, q: float, *, support: Column | None = None, split_ties: bool = False) -> Column:
    """The first value whose cumulative probability is above q; split: half way to the first at q or above."""
    s, c = support if support is not None else grid(p), running(p)

    def first(test) -> Column:  # noqa: ANN001
        at = F.array_position(F.transform(c, lambda x: test(x)), F.lit(True)).cast("int")
        return F.get(s, F.greatest(at - 1, F.lit(0)))

    above = first(lambda x: x > q)
    return (above + first(lambda x: x >= q)) / 2 if split_ties else above


def median(p: Column | str) -> Column:
    return quantile(p, 0.5)


def lower_percentile(p: Column | str) -> Column:
    return quantile(p, 0.01)


def semi_deviation(p: Column | str) -> Column:
    """Root of the mean squared distance below the mean."""
    m = mean(p)
    return F.sqrt(total(F.zip_with(grid(p), column(p), lambda s, x: x * F.pow(F.greatest(m - s, F.lit(0.0)), F.lit(2.0)))))


def deviation(p: Column | str, support: Column | None = None) -> Column:
    s = support if support is not None else grid(p)
    m = mean(p, s)
    return F.sqrt(total(F.zip_with(s, column(p), lambda v, x: x * F.pow(m - v, F.lit(2.0)))))


def compare_modes(a: Column | str, b: Column | str) -> Column:
    return F.signum(mode(a, split_ties=True) - mode(b, split_ties=True))


def compare_rounded_means(a: Column | str, b: Column | str) -> Column:
    return F.signum(rounded_mean(a) - rounded_mean(b))


def compare_medians(a: Column | str, b: Column | str) -> Column:
    return F.signum(median(a) - median(b))


def compare_lower_percentiles(a: Column | str, b: Column | str) -> Column:
    return F.signum(lower_percentile(a) - lower_percentile(b))


def compare_quantiles(a: Column | str, b: Column | str) -> Column:
    """The share of quantiles at which the first distribution leads, less that at which the second does."""

    def steps(p: Column | str, d: float) -> Column:
        return F.transform(F.slice(running(p), F.lit(1), F.size(column(p)) - 1), lambda c: F.struct(c.alias("at"), F.lit(d).alias("d")))

    merged = F.array_sort(F.concat(steps(a, 1.0), steps(b, -1.0)))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("lead"), F.lit(None).cast("double").alias("last"))
    end = F.aggregate(merged, start, lambda s, x: F.struct((s["sum"] + F.coalesce(F.signum(s["lead"]) * (x["at"] - s["last"]), F.lit(0.0))).alias("sum"), (s["lead"] + x["d"]).alias("lead"), x["at"].alias("last")))
    return end["sum"]


def superiority(a: Column | str, b: Column | str) -> Column:
    """P(X1 >= X2) - P(X1 <= X2)."""
    below = dot(running(a), column(b))
    return 1 - below + dot(column(a), column(b)) - below


def _pairs(a: Column | str, b: Column | str, f) -> Column:  # noqa: ANN001
    """Sum of p1 * p2 * f(value 1 - value 2) over all pairs of labels."""
    x, y = (F.zip_with(column(p), grid(p), lambda u, v: F.struct(u.alias("p"), v.alias("s"))) for p in (a, b))
    return total(F.transform(x, lambda u: u["p"] * total(F.transform(y, lambda v: v["p"] * f(u["s"] - v["s"])))))


def compare_means(a: Column | str, b: Column | str) -> Column:
    """E(d) / (E|d| + sd(d)) of the difference of independent draws; 0 where the divisor is 0.001 or less."""
    gap = _pairs(a, b, lambda d: d)
    spread = F.sqrt(F.greatest(_pairs(a, b, lambda d: d * d) - gap * gap, F.lit(0.0)))
    below = _pairs(a, b, F.abs) + spread
    return F.when(below > 1e-3, gap / below).otherwise(F.lit(0.0))


def compare_risk_averse(a: Column | str, b: Column | str) -> Column:
    """As compare_means, of the means less their semi-deviations."""
    off = semi_deviation(a) - semi_deviation(b)
    gap = mean(a) - mean(b)
    spread = F.sqrt(F.greatest(_pairs(a, b, lambda d: d * d) - gap * gap, F.lit(0.0)))
    below = _pairs(a, b, lambda d: F.abs(d - off)) + spread
    return F.when(below > 1e-3, (gap - off) / below).otherwise(F.lit(0.0))


def one_hot(k: Column, at: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.when(i == at, F.lit(1.0)).otherwise(F.lit(0.0)))


def _safe(a: Column, b: Column, least: float) -> Column:
    return F.when(b > least, a / b).otherwise(F.lit(0.0))


def pairwise_predictions(forward: Column | str, backward: Column | str) -> dict[str, Column]:
    """Predictions in [-1, 1] from the distributions over k (odd) preferences in both orders of presentation: mode,
    median and mean, from the symmetric distribution (s1) or from each order's own prediction (s2)."""
    f, b = column(forward), column(backward)
    s = centred(f)
    size = F.transform(s, lambda x: F.abs(x))
    both = F.zip_with(f, F.reverse(b), lambda x, y: (x + y) / 2)
    clamp = lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0))

    def each_way(g) -> Column:  # noqa: ANN001
        x, y = g(f), g(b)
        return _safe(x - y, F.abs(x) + F.abs(y), 0.0)

    def scaled_mean(p: Column) -> Column:
        return _safe(mean(p, s), mean(p, size) + deviation(p, s), 1e-4)

    found = {
        "mode_s2": each_way(lambda p: mode(p, support=s, split_ties=True)),
        "mode_s1": F.signum(mode(both, support=s, split_ties=True)),
        "medi_s2": each_way(lambda p: quantile(p, 0.5, support=s, split_ties=True)),
        "medi_s1": F.signum(quantile(both, 0.5, support=s, split_ties=True)),
        "mean_s2": (scaled_mean(f) - scaled_mean(b)) / 2,
        "mean_s1": scaled_mean(both),
    }
    return {k: clamp(v) for k, v in found.items()}


def ranking_distribution(p: Column | str) -> Column:
    """A ranking's probabilities made ready: two options get a tie of probability 0 between, near ties and
    distributions with NaN become a sure tie."""
    a = column(p)
    k = F.size(a)
    bad = F.exists(a, lambda x: F.isnan(x))
    x, y = F.get(a, F.lit(0)), F.get(a, F.lit(1))
    near = F.abs(x - y) <= 1e-6 + 1e-5 * F.abs(y)
    two = F.when(bad | near, F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))).otherwise(F.array(x, F.lit(0.0), y))
    return F.when(k == 2, two).when(bad, one_hot(k, F.floor(k / 2))).otherwise(a)


def score_difference(first: Column | str, second: Column | str) -> Column:
    """The distribution over 2k - 1 differences of the second score less the first's most likely; with a NaN in either
    both scores are the lowest."""
    a, b = column(first), column(second)
    k = F.size(a)
    bad = F.exists(a, lambda x: F.isnan(x)) | F.exists(b, lambda x: F.isnan(x))
    low = one_hot(k, F.lit(0))
    a, b = F.when(bad, low).otherwise(a), F.when(bad, low).otherwise(b)
    top = F.array_position(a, F.array_max(a)).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), 2 * k - 2), lambda j: F.when((j - (k - 1) + top >= 0) & (j - (k - 1) + top < k), F.get(b, j - (k - 1) + top)).otherwise(F.lit(0.0)))
