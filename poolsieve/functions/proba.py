"""Scores of class probabilities: arrays of doubles, arrays of passes of them, arrays of tokens of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP = 1e-8


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: inside a lambda, an outer expression would be for each element."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def mean(xs: Column) -> Column:
    return let(xs, lambda v: total(v) / F.size(v))


def entropy(p: Column) -> Column:
    """-sum p log p, p clipped below in the logarithm."""
    return total(F.transform(p, lambda x: -x * F.log(F.least(F.greatest(x, F.lit(CLIP)), F.lit(1.0)))))


def argmax(p: Column) -> Column:
    """Position of the largest value, from 0; the first of equal ones."""
    return let(p, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def _by_class(passes: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of each class's values over the passes."""
    return let(passes, lambda v: F.transform(F.sequence(F.lit(0), F.size(F.get(v, F.lit(0))) - 1), lambda c: f(F.transform(v, lambda p: F.get(p, c)))))


def mean_pass(passes: Column) -> Column:
    """Mean over passes, class by class."""
    return _by_class(passes, mean)


def mean_entropy(passes: Column) -> Column:
    return entropy(mean_pass(passes))


def bald(passes: Column) -> Column:
    """Entropy of the mean less mean of the entropies."""
    return let(passes, lambda v: entropy(mean_pass(v)) - mean(F.transform(v, entropy)))


def variation_ratio(passes: Column) -> Column:
    """1 - share of the passes that agree with the most frequent class."""

    def share(votes: Column) -> Column:
        counts = F.transform(F.array_distinct(votes), lambda v: F.size(F.filter(votes, lambda w: w == v)))
        return 1 - F.array_max(counts) / F.size(votes)

    return let(F.transform(passes, argmax), share)


def sampled_max(passes: Column) -> Column:
    return 1 - F.array_max(mean_pass(passes))


def variance(passes: Column) -> Column:
    """Variance over passes, summed over classes."""
    spread = lambda v: let(mean(v), lambda m: mean(F.transform(v, lambda x: (x - m) * (x - m))))
    return total(_by_class(passes, lambda v: let(v, spread)))


def over_tokens(score, tokens: Column) -> Column:  # noqa: ANN001
    """Mean over tokens of a score of each token's passes."""
    return mean(F.transform(tokens, score))


def mnlp(tokens: Column) -> Column:
    """-mean over tokens of the log of the largest probability."""
    return -mean(F.transform(tokens, lambda p: F.log(F.array_max(p))))


def least_confidence(p: Column) -> Column:
    return 1 - F.array_max(p)


def margin(p: Column) -> Column:
    """1 + second largest - largest probability."""
    return let(F.array_sort(p), lambda v: 1 + F.element_at(v, -2) - F.element_at(v, -1))


def softmax(logits: Column) -> Column:
    share = lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s))
    return let(logits, lambda v: let(F.array_max(v), lambda top: let(F.transform(v, lambda x: F.exp(x - top)), share)))


def smoothed(p: Column, smoothing: float | str | bool) -> Column:
    """Pseudo-label: a share for the largest class and the rest spread over the others, the probabilities
    (``natural``), or the largest class's number (False)."""
    if smoothing == "natural":
        return p
    if smoothing is False:
        return argmax(p)
    share = F.lit(float(smoothing))
    return let(p, lambda v: let(argmax(v), lambda best: F.transform(v, lambda x, i: F.when(i == best, share).otherwise((1 - share) / (F.size(v) - 1)))))


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: (c == label).cast("double"))


def weighted_loss(p: Column, label: Column, weight: Column) -> Column:
    """-w sum y log p of one row, y an array like p."""
    return -weight * total(F.zip_with(p, label, lambda x, y: y * F.log(F.greatest(x, F.lit(CLIP)))))
