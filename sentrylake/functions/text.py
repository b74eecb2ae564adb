"""Column expressions shared by the operators."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentrylake.functions import fixed_values as V


def present(c) -> Column:
    """Trimmed text, or null when the text only says that a value is absent."""
    t = F.trim(c if isinstance(c, Column) else F.col(c))
    return F.when(~F.lower(t).isin(V.ABSENT_WORDS), t)


def contains_any(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def keyword_ladder(c: Column, ladder, default) -> Column:
    """The label of the first rung with a keyword in `c` (already lower case)."""
    out = F.lit(default)
    for label, words in reversed(ladder):
        out = F.when(contains_any(c, words), F.lit(label)).otherwise(out)
    return out


def level(c: Column, steps) -> Column:
    """Map a number to the label of the first lower bound it reaches."""
    out = None
    for bound, label in reversed(steps):
        out = F.lit(label) if bound is None else F.when(c >= bound, label).otherwise(out)
    return out


def fired(pairs) -> Column:
    """Array of the values whose condition holds, in the given order."""
    return F.filter(
        F.array(*[F.when(cond, value) for cond, value in pairs]),
        lambda x: x.isNotNull(),
    )


def basename(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"([^\\/]*)$", 1))


def longest_label(name: Column) -> Column:
    """The longest dot-separated label; the first of several equally long ones."""
    labels = F.split(name, r"\.")
    return F.aggregate(
        labels,
        F.lit(""),
        lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best),
    )


def shannon_entropy(text: Column) -> Column:
    """Entropy in bits of the characters of `text`, ignoring case."""
    low = F.lower(text)
    chars = F.split(low, "")
    n = F.length(low).cast("double")
    share = lambda ch: (n - F.length(F.replace(low, ch, F.lit("")))) / n
    return F.when(n == 0, F.lit(0.0)).otherwise(
        F.aggregate(
            F.filter(F.array_distinct(chars), lambda ch: ch != ""),
            F.lit(0.0),
            lambda acc, ch: acc - share(ch) * F.log2(share(ch)),
        )
    )


def detail_number(details: Column, key: str) -> Column:
    """The whole number of the last `key=` item of a `k=v|k=v` text, else null."""
    text = F.regexp_extract(details, rf"^(?:.*\|)?{key}=([^|=]*)(?:\||$)", 1)
    return F.trim(text).try_cast("bigint")
