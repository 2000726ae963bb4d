"""Word, n-gram and token-label functions as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .proba import let


def words(text: Column) -> Column:
    """Lower-case words without ASCII punctuation."""
    bare = F.lower(F.regexp_replace(text, r"\p{Punct}", ""))
    return F.filter(F.split(bare, r"\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != "")


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def ngrams(items: Column, n: int) -> Column:
    """All runs of n items, joined by a space; empty where there are fewer than n."""

    def runs(v: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(v) - (n - 1)), lambda i: F.array_join(F.slice(v, i, n), " "))
        return F.when(F.size(v) >= n, every).otherwise(F.array().cast("array<string>"))

    return let(items, runs)


def novel_share(summary: Column, text: Column, n: int) -> Column:
    """Share of the summary's n-gram occurrences that the text has not; null without n-grams."""

    def share(mine: Column) -> Column:
        new = let(F.array_intersect(mine, ngrams(text, n)), lambda both: F.size(F.filter(mine, lambda g: ~F.array_contains(both, g))))
        return F.when(F.size(mine) > 0, new / F.size(mine))

    return let(ngrams(summary, n), share)


def uncopied_share(summary: Column, text: Column, n: int) -> Column:
    """1 - share of the summary's words that are part of an n-gram which the text has too; null without n-grams."""

    def share(v: Column) -> Column:
        copied = F.array_distinct(F.flatten(F.transform(F.array_intersect(ngrams(v, n), ngrams(text, n)), lambda g: F.split(g, " "))))
        hits = let(copied, lambda c: F.size(F.filter(v, lambda w: F.array_contains(c, w))))
        return F.when(F.size(v) >= n, 1 - hits / F.size(v))

    return let(summary, share)


def align_labels(labels: Column, word_ids: Column, subtokens: str = "ignore") -> Column:
    """Labels of words spread over sub-tokens. A sub-token without a word gets -100, the first of a word its label,
    the others -100 (``ignore``), the label (``repeat``), or its inside form, odd labels + 1 (``inside``)."""
    if subtokens not in ("ignore", "repeat", "inside"):
        raise ValueError(f"unknown treatment of sub-tokens: {subtokens}")

    def spread(given: Column, words_: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            label = F.get(given, w)
            later = {"ignore": F.lit(-100), "repeat": label, "inside": F.when(label % 2 == 1, label + 1).otherwise(label)}[subtokens]
            return F.when(w.isNull(), F.lit(-100)).when((i == 0) | ~w.eqNullSafe(F.get(words_, i - 1)), label).otherwise(later).cast("int")

        return F.transform(words_, one)

    return let(labels, lambda given: let(word_ids, lambda words_: spread(given, words_)))


def first_subtokens(word_ids: Column) -> Column:
    """Positions, from 1 on, at which a word begins."""

    def begins(v: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(v) - 1)
        return F.filter(at, lambda i: (i >= 1) & F.get(v, i).isNotNull() & ~F.get(v, i).eqNullSafe(F.get(v, i - 1)))

    return let(word_ids, lambda v: F.when(F.size(v) > 0, begins(v)).otherwise(F.array().cast("array<int>")))


def without_padding(values: Column, labels: Column, padding: int = -100) -> Column:
    """Values whose label is not the padding."""
    return F.transform(F.filter(F.arrays_zip(values.alias("v"), labels.alias("l")), lambda x: x["l"] != padding), lambda x: x["v"])


def named_labels(labels: Column, names: list[str]) -> Column:
    known = F.array(*[F.lit(n) for n in names])
    return F.transform(labels, lambda i: F.get(known, i))


# fixed values: suffixes of Porter's algorithm (1980), steps 2 to 4
STEP2 = "ational ate,tional tion,enci ence,anci ance,izer ize,abli able,alli al,entli ent,eli e,ousli ous,ization ize,ation ate,ator ate,alism al,iveness ive,fulness ful,ousness ous,aliti al,iviti ive,biliti ble"
STEP3 = "icate ic,ative ,alize al,iciti ic,ical ic,ful ,ness "
STEP4 = "al,ance,ence,er,ic,able,ible,ant,ement,ment,ent,ion,ou,ism,ate,iti,ous,ive,ize"


def _consonants(word: str) -> list[bool]:
    out: list[bool] = []
    for i, c in enumerate(word):
        out.append(c not in "aeiou" and not (c == "y" and i > 0 and out[-1]))
    return out


def _measure(stem: str) -> int:
    c = _consonants(stem)
    return sum(b and not a for a, b in zip(c, c[1:], strict=False))


def _cvc(stem: str) -> bool:
    return len(stem) > 2 and _consonants(stem)[-3:] == [True, False, True] and stem[-1] not in "wxy"


def porter(word: str) -> str:
    """Porter's stemmer."""
    if len(word) < 3:
        return word
    vowel = lambda s: not all(_consonants(s))
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: len(word) - len(end)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end):
                if vowel(stem := word[: -len(end)]):
                    double = len(stem) > 1 and stem[-1] == stem[-2] and _consonants(stem)[-1] and stem[-1] not in "lsz"
                    word = stem + "e" if stem.endswith(("at", "bl", "iz")) else stem[:-1] if double else stem + "e" if _measure(stem) == 1 and _cvc(stem) else stem
                break
    if word.endswith("y") and vowel(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP2, STEP3):
        for end, new in sorted((tuple(r.split(" ")) for r in rules.split(",")), key=lambda r: -len(r[0])):
            if word.endswith(end):
                word = word[: -len(end)] + new if _measure(word[: -len(end)]) else word
                break
    for end in sorted(STEP4.split(","), key=len, reverse=True):
        if word.endswith(end):
            stem = word[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                word = stem
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _cvc(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stems of tokens of more than three letters; each different token of a batch is stemmed once."""
    for batch in batches:
        known: dict[str, str] = {}
        stem = lambda t: known.setdefault(t, porter(t)) if len(t) > 3 else t  # noqa: B023, E731
        yield batch.map(lambda ts: None if ts is None else [stem(t) for t in ts])  # noqa: B023


def _lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    where: dict[str, int] = {}
    for i, t in enumerate(a):
        where[t] = where.get(t, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for t in b:
        hit = row & where.get(t, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.LongType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _lcs(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int64")
