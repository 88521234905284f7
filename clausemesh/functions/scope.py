"""Scope paths: prefix tests, priorities, life cycle, conditions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as K
from .units import literal_map


def _size(scope: Column) -> Column:
    return F.coalesce(F.size(scope), F.lit(0))


def chunk_in_scope(chunk_scope: Column, active: Column) -> Column:
    """Retrieval filter: the active scope is a prefix of the chunk's own, non-empty scope."""
    return active.isNull() | (
        (_size(chunk_scope) > 0)
        & F.coalesce(F.slice(chunk_scope, F.lit(1), _size(active)) == active, F.lit(False))
    )


def constraint_in_scope(scope: Column, active: Column) -> Column:
    """Solver filter: the constraint's scope is a prefix of the active one, or absent."""
    return (
        active.isNull()
        | scope.isNull()
        | F.coalesce(F.slice(active, F.lit(1), F.size(scope)) == scope, F.lit(False))
    )


def scope_text(scope: Column, separator: str = " ") -> Column:
    return F.coalesce(F.array_join(scope, separator), F.lit(""))


def _head(scope: Column) -> Column:
    return F.lower(F.get(scope, F.lit(0)))


def scope_level(scope: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(K.PRIORITY_LEVEL), _head(scope)), F.lit(K.DEFAULT_LEVEL))


def scope_doc_type(scope: Column) -> Column:
    head = _head(scope)
    return F.when(head.isin(*K.PRIORITY_LEVEL), head).otherwise(F.lit("project"))


def scope_score(
    doc_type: Column, scope: Column, has_fields: Column, has_headers: Column, boost: Column | bool = True
) -> Column:
    """Re-ranking weight of a chunk, raised by form fields and column headers when boosted."""
    by_type = F.coalesce(F.try_element_at(literal_map(K.DOC_TYPE_LEVEL), doc_type), F.lit(K.DEFAULT_LEVEL))
    base = (
        F.when(doc_type.isNotNull(), by_type / 100.0)
        .when(_size(scope) > 0, scope_level(scope) / 100.0)
        .otherwise(F.lit(0.0))
    )
    on = F.lit(boost) if isinstance(boost, bool) else boost
    return F.greatest(
        base,
        F.when(on & has_fields, F.lit(K.FORM_FIELD_WEIGHT)),
        F.when(on & has_headers, F.lit(K.COLUMN_HEADER_WEIGHT)),
    )


def label_score(scope: Column) -> Column:
    """1.0 down to 0.2 for the five known scopes; unlike scope_score, unknown is 0."""
    return F.coalesce(
        F.try_element_at(literal_map({k: v / 100.0 for k, v in K.PRIORITY_LEVEL.items()}), _head(scope)),
        F.lit(0.0),
    )


def provision_id(scope: Column) -> Column:
    found = F.transform(scope, lambda s: F.regexp_extract(s, K.PROVISION, 1))
    return F.get(F.filter(found, lambda s: s != ""), F.lit(0))


def _has_word(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(words))


def lifecycle_status(scope: Column, text: Column, superseded: Column) -> Column:
    """deprecated, else the first of draft / review / transitional found in scope, then text."""
    in_scope, in_text = F.lower(scope_text(scope)), F.lower(F.coalesce(text, F.lit("")))
    status = F.when(F.coalesce(superseded, F.lit(False)), F.lit("deprecated"))
    for place in (in_scope, in_text):
        for name, words in K.LIFECYCLE_WORDS:
            status = status.when(_has_word(place, words), F.lit(name))
    return status.otherwise(F.lit("active"))


def is_binding(status: Column) -> Column:
    return ~status.isin(*K.NOT_BINDING)


def conditions(text: Column) -> Column:
    """ARRAY<STRUCT<parameter, operator, value>> of applicability conditions."""
    found = [
        F.struct(
            F.lit(name).alias("parameter"),
            F.lit("=").alias("operator"),
            F.regexp_extract(text, pattern, 1).alias("value"),
        )
        for name, pattern in K.CONDITION_PATTERNS
    ]
    return F.filter(F.array(*found), lambda c: c.value != "")


def branch_key(conds: Column) -> Column:
    usable = F.filter(
        conds,
        lambda c: c.parameter.isin("environment", "condition") & (F.coalesce(c.value, F.lit("")) != ""),
    )
    return F.coalesce(F.get(usable, F.lit(0)).getField("value"), F.lit("general"))
