"""Rule tables compiled into expressions. A rule is (label, keywords), in order of priority."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .containment import contained
from .text import CJK, any_of, has_any, has_chinese, holds_any, let


def first_label(c: Column, rules: Sequence[tuple[str, str | Sequence[str]]], otherwise: str = "") -> Column:
    """Label of the first rule with a keyword in the text. Keywords are a list of words, or a pattern."""
    holds = lambda k: c.rlike(k) if isinstance(k, str) else holds_any(c, list(k))
    return F.coalesce(*[F.when(holds(k), F.lit(label)) for label, k in rules], F.lit(otherwise))


def count_words(c: Column, words: Sequence[str]) -> Column:
    """How many different words are in the text."""
    return sum((F.contains(c, F.lit(w)).cast("int") for w in words), F.lit(0))


def by_script(c: Column, lists: Sequence[Sequence[str]], use: Callable[[list[list[str]]], Column]) -> Column:
    """use(lists) of words; a text without a Chinese sign is asked for the words without one alone, as it can hold no other."""
    plain = [[w for w in words if not re.search(f"[{CJK}]", w)] for words in lists]
    if plain == [list(words) for words in lists]:
        return use(plain)
    return F.when(c.isNull() | has_chinese(c), use([list(words) for words in lists])).otherwise(use(plain))


def most_words(c: Column, rules: Sequence[tuple[str, Sequence[str]]], none: str = "unknown") -> Column:
    """Label with the most of its words in the text, of equals the first."""

    def label(counts: Column) -> Column:
        most = F.array_max(counts)
        return F.when(most == 0, none).otherwise(F.element_at(F.array(*[F.lit(name) for name, _ in rules]), F.array_position(counts, most).cast("int")))

    return let(by_script(c, [words for _, words in rules], lambda lists: F.array(*[count_words(c, words) for words in lists])), label)


def longest_term(c: Column, terms: Sequence[str]) -> Column:
    """The longest term in the text, of equals the first, else ''."""
    ordered = sorted(terms, key=len, reverse=True)
    return F.coalesce(*[F.when(F.contains(c, F.lit(t)), F.lit(t)) for t in ordered], F.lit(""))


def leftmost_term(c: Column, terms: Sequence[str]) -> Column:
    """The term that begins first in the text, of those the longest, else ''."""
    return F.regexp_extract(c, any_of(terms), 0)


def label_by_table(df: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """(key, label) of the first rule of a table (priority, label, pattern) whose pattern a text holds; texts without one are left out.

    For rule tables that are data, of any size: texts and patterns meet
    through an index of the patterns' rare parts (containment.contained).
    """
    first = rules.groupBy("pattern").agg(F.min(F.struct("priority", "label")).alias("rule"))
    patterns = first.select(F.col("pattern").alias("name"), "rule")
    hits = contained(df.select(F.col(key).alias("id"), F.col(text).alias("text")), patterns.select("name")).join(patterns, "name")
    return hits.groupBy(F.col("id").alias(key)).agg(F.min("rule").alias("rule")).select(key, F.col("rule.label").alias("label"))


def is_blacklisted(c: Column, words: Sequence[str]) -> Column:
    return has_any(c, words)
