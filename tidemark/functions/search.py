"""Text search as column expressions: a small query language over whole words, without stemming."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import compare_form


def parse_query(query: str) -> list[list[tuple[bool, str]]]:
    """Alternatives of (wanted, words): "a phrase", -word and `or` between alternatives; blanks mean and."""
    out: list[list[tuple[bool, str]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query.lower()):
        if word == "or" and not minus:
            out.append([])
            continue
        words = " ".join(re.findall(r"[^\W_]+", phrase or word))
        if words:
            out[-1].append((not minus, words))
    return [a for a in out if a]


def matches(text: Column, query: str) -> Column:
    """Whether the text answers the query; a query without words matches nothing, a null text is an empty one."""
    padded = F.concat(F.lit(" "), compare_form(F.coalesce(text, F.lit(""))), F.lit(" "))
    has = lambda wanted, words: F.contains(padded, F.lit(f" {words} ")) == F.lit(wanted)
    alternatives = [reduce(Column.__and__, [has(*term) for term in a]) for a in parse_query(query)]
    return reduce(Column.__or__, alternatives) if alternatives else F.lit(False)


def suggestions(name: Column, typed: str) -> Column:
    """Edit distance of a name within reach of what was typed, else null: at most 2, or a third of its length."""
    distance = F.levenshtein(F.lower(name), F.lit(typed.lower()))
    return F.when(distance <= max(2, len(typed) // 3), distance)


def occurrences(text: Column, query: str) -> Column:
    """How often the wanted words and phrases of a query stand in a text, as whole words."""
    padded = F.concat(F.lit("  "), F.regexp_replace(compare_form(F.coalesce(text, F.lit(""))), " ", "  "), F.lit("  "))
    wanted = dict.fromkeys(words for a in parse_query(query) for yes, words in a if yes)
    each = [F.regexp_count(padded, F.lit(" " + re.escape(w).replace("\\ ", " ").replace(" ", "  ") + " ")) for w in wanted]
    return reduce(Column.__add__, each) if each else F.lit(0)


def rank(text: Column, query: str) -> Column:
    """Occurrences against the length of the text: (number of hits) / (1 + ln of its words)."""
    words = F.greatest(F.size(F.split(compare_form(F.coalesce(text, F.lit(""))), " ")), F.lit(1))
    return occurrences(text, query) / (1 + F.ln(words))


def ladder(rows: DataFrame, column: str, typed: str) -> DataFrame:
    """Rows with `mode`, from the first rung that finds any: all words, any word, or the text as typed. One pass looks for the
    rung and one takes its rows."""
    terms = [t for a in parse_query(typed) for t in a]
    some = [matches(F.col(column), f'"{words}"') for yes, words in terms if yes]
    rungs = {"all": matches(F.col(column), typed), "any": reduce(Column.__or__, some) if some else F.lit(False), "literal": F.coalesce(F.contains(F.lower(column), F.lit(typed.lower())), F.lit(False))}
    found = rows.agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(name) for name, c in rungs.items()]).first()
    mode = next((name for name in rungs if found[name]), "all")
    return rows.filter(rungs[mode]).withColumn("mode", F.lit(mode))
