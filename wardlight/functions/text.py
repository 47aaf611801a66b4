"""Labels, keyword rules and text prefixes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_of(code: Column, labels: Mapping, default: str | None = None) -> Column:
    """Label of a code; codes without a label give ``default``."""
    chain = F
    for key, label in labels.items():
        chain = chain.when(code == F.lit(key), F.lit(label))
    return chain.otherwise(F.lit(default))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return reduce(or_, [text.contains(word) for word in words])


def keyword_class(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """Class of the first rule with a keyword inside the upper-cased text."""
    upper = F.upper(text)
    chain = F
    for name, words in rules:
        chain = chain.when(contains_any(upper, words), F.lit(name))
    return chain.otherwise(F.lit(default))


def not_starting_with(text: Column, prefixes: Sequence[str]) -> Column:
    """True unless the upper-cased text starts with a prefix; no text passes."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    return ~reduce(or_, [upper.startswith(prefix) for prefix in prefixes])


def joined(*parts: Column | str) -> Column:
    """Concatenation in which a missing part counts as empty text."""
    columns = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.concat(*columns)
