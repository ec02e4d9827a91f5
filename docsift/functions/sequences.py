"""Expressions over token and probability arrays: n-gram bans, loop detection, CTC decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsift.functions.geometry import bind

NGRAM, MIN_RUN, SHORT_PERIODS, LONG_PERIODS = 4, 40, (2, 12), (13, 60)


def argmax(values: Column) -> Column:
    """Place of the first maximum, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def banned_next(seq: Column, n: int = NGRAM) -> Column:
    """Tokens that would repeat an n-gram if they came next; sorted, distinct."""
    size = F.size(seq)
    last = F.slice(seq, F.greatest(size - (n - 2), F.lit(1)), F.lit(n - 1))
    at = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
    same = F.filter(at, lambda i: F.slice(seq, i, F.lit(n - 1)) == last)
    return F.array_sort(F.array_distinct(F.transform(same, lambda i: F.element_at(seq, i + n - 1))))


def _cycles(seq: Column, period: Column, times: int) -> Column:
    """The last period * times entries repeat with the period."""
    size = F.size(seq)
    tail = F.slice(seq, F.greatest(size - period * times + 1, F.lit(1)), period * times)
    ahead, behind = F.slice(tail, period + 1, period * (times - 1)), F.slice(tail, F.lit(1), period * (times - 1))
    return (size >= period * times) & (ahead == behind)


def looping(seq: Column, min_run: int = MIN_RUN) -> Column:
    """A run of one token, six rounds of a short cycle or three of a long one at the end."""
    size = F.size(seq)
    tail = F.slice(seq, F.greatest(size - min_run + 1, F.lit(1)), F.lit(min_run))
    one = F.size(F.array_distinct(tail)) == 1
    short = F.exists(F.sequence(F.lit(SHORT_PERIODS[0]), F.lit(SHORT_PERIODS[1])), lambda p: _cycles(seq, p, 6))
    long = F.exists(F.sequence(F.lit(LONG_PERIODS[0]), F.lit(LONG_PERIODS[1])), lambda p: _cycles(seq, p, 3))
    return (size >= min_run) & (one | short | long)


def softmax(row: Column) -> Column:
    top = F.array_max(row)
    powers = F.transform(row, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def softmax_guard(rows: Column) -> Column:
    """The matrix as it is if it holds probabilities, else the softmax of each row."""
    negative = F.exists(rows, lambda r: F.exists(r, lambda x: x < 0))
    off = F.exists(rows, lambda r: F.abs(F.aggregate(r, F.lit(0.0), lambda a, x: a + x) - 1.0) > 1e-2 + 1e-5)
    return F.when(negative | off, F.transform(rows, softmax)).otherwise(rows)


def ctc_decode(probs: Column, charset: Column) -> Column:
    """struct(text, score): repeats collapsed, blanks (0) dropped, score the mean maximum of what is kept."""
    best = F.transform(probs, lambda r: F.struct(argmax(r).alias("k"), F.array_max(r).cast("double").alias("p")))

    def fresh(all_best: Column) -> Column:
        """What is no blank and no repeat."""
        return F.filter(all_best, lambda x, i: (x["k"] != 0) & ((i == 0) | (F.get(all_best, i - 1)["k"] != x["k"])))

    def decoded(kept: Column) -> Column:
        text = F.array_join(F.transform(F.filter(kept, lambda x: x["k"] < F.size(charset)), lambda x: F.element_at(charset, x["k"] + 1)), "")
        total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x["p"])
        return F.struct(text.alias("text"), F.coalesce(F.try_divide(total, F.size(kept).cast("double")), F.lit(0.0)).alias("score"))

    return bind(bind(best, fresh), decoded)


def charset_for(chars: Column, classes: Column) -> Column:
    """Blank, the characters, and a blank space if one more class is there; an error if the numbers do not fit."""
    base = F.concat(F.array(F.lit("<blank>")), chars)
    message = F.concat(F.size(base).cast("string"), F.lit(" symbols cannot name "), classes.cast("string"), F.lit(" classes"))
    return F.when(classes == F.size(base) + 1, F.concat(base, F.array(F.lit(" ")))).when(classes == F.size(base), base).otherwise(F.raise_error(message).cast("array<string>"))
