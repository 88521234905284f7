"""Search terms: word tokens with accents folded, and parsed search expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """Accented Latin, Greek and Cyrillic letters and their base letter, by decomposition."""
    source, target = [], []
    for code in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        char = chr(code)
        base = unicodedata.normalize("NFD", char)[0]
        if base != char and char.isalpha():
            source.append(char)
            target.append(base)
    return "".join(source), "".join(target)


ACCENTED, PLAIN = _accent_table()
NOT_TOKEN = r"[^\p{L}\p{N}\p{Co}]+"


def fold(text: Column) -> Column:
    bare = F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"\p{Mn}+", "")
    return F.lower(bare)


def tokenize(text: Column) -> Column:
    """Lower-case tokens of letters and digits; a run of CJK characters is one token."""
    return F.filter(F.split(fold(text), NOT_TOKEN), lambda t: t != "")


def search_terms(query: Column) -> Column:
    """ARRAY<STRUCT<phrase ARRAY<STRING>, negated>>: white-space separated, '-' negates."""
    words = F.filter(F.split(query, r"[\p{Z}\t-\r]+"), lambda w: w != "")
    terms = F.transform(
        words,
        lambda w: F.struct(
            tokenize(F.when(w.startswith("-"), F.substr(w, F.lit(2))).otherwise(w)).alias("phrase"),
            w.startswith("-").alias("negated"),
        ),
    )
    return F.filter(terms, lambda t: F.size(t.phrase) > 0)


def _last_matches(token: Column, phrase: Column, prefix: bool) -> Column:
    last = F.element_at(phrase, -1)
    return token.startswith(last) if prefix else token == last


def _hit_positions(tokens: Column, phrase: Column, prefix: bool) -> Column:
    """Start positions of a phrase of several words."""
    n, m = F.size(tokens), F.size(phrase)
    head = F.slice(phrase, F.lit(1), m - 1)
    return F.filter(
        F.sequence(F.lit(0), F.greatest(n - m, F.lit(0))),
        lambda i: _last_matches(F.get(tokens, i + m - 1), phrase, prefix) & (F.slice(tokens, i + 1, m - 1) == head),
    )


def phrase_hits(tokens: Column, phrase: Column, prefix: bool) -> Column:
    """How often the phrase occurs; with `prefix`, its last word may continue."""
    return (
        F.when(F.size(phrase) == 1, F.size(F.filter(tokens, lambda t: _last_matches(t, phrase, prefix))))
        .when(F.size(tokens) < F.size(phrase), F.lit(0))
        .otherwise(F.size(_hit_positions(tokens, phrase, prefix)))
    )


def phrase_occurs(tokens: Column, phrase: Column, prefix: bool) -> Column:
    """Whether the phrase occurs at all; stops at the first single-word match."""
    return (
        F.when(F.size(phrase) == 1, F.exists(tokens, lambda t: _last_matches(t, phrase, prefix)))
        .when(F.size(tokens) < F.size(phrase), F.lit(False))
        .otherwise(F.size(_hit_positions(tokens, phrase, prefix)) > 0)
    )
