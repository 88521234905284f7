"""Functions for use in SQL, made from the same column expressions that the DataFrame operators use.

A column is turned into the SQL text of its own expression, so nothing is written twice: value functions become temporary
SQL functions, and the numbers with units of a text a table function, for `FROM t, LATERAL hints(t.text)`.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import fixed as K
from . import ids
from . import scope as S
from . import text as X
from . import tokens as TK
from . import units as U

_STRING = re.compile(r"'(?:[^'\\]|\\.|'')*'", re.S)
#: Operators and words that Spark writes like functions; between back quotes they can be called as such.
_CALLED = re.compile(r"(?<![\w`'=<>!+*/%&|^~-])(<=>|<=|>=|!=|[=<>!+*/%&|^~-]|and|or|not|in|like|rlike|between)\(", re.I)


def sql_text(column: Column) -> str:
    """SQL that gives the same expression when it is parsed again."""
    text = column._jc.node().sql()
    out, at = [], 0
    for literal in _STRING.finditer(text):
        out += [_CALLED.sub(r"`\1`(", text[at : literal.start()]), literal.group()]
        at = literal.end()
    return "".join(out) + _CALLED.sub(r"`\1`(", text[at:])


def functions() -> dict[str, tuple[str, str, Column]]:
    """name: (parameters, result, body over columns of the parameters' names)."""
    c = F.col
    return {
        "estimate_tokens": ("t STRING", "INT", X.estimate_tokens(c("t")).cast("int")),
        "to_celsius": ("v DOUBLE, u STRING", "DOUBLE", U.to_celsius(c("v"), c("u"))),
        "normalize_unit": ("v DOUBLE, u STRING", "STRUCT<value: DOUBLE, unit: STRING, category: STRING>", U.normalize_unit(c("v"), c("u"))),
        "normalize_parameter": ("n STRING", "STRING", U.normalize_parameter(c("n"))),
        "parse_deadline": ("t STRING", "STRUCT<reference_event: STRING, offset_days: BIGINT, is_working_day: BOOLEAN>", U.parse_deadline(c("t"))),
        "provision_id": ("s ARRAY<STRING>", "STRING", S.provision_id(c("s"))),
        "search_tokens": ("t STRING", "ARRAY<STRING>", TK.tokenize(c("t"))),
        "request_id": ("t STRING, d STRING, v INT", "STRING", ids.request_id(c("t"), c("d"), c("v"))),
        "cache_key": ("t STRING, m STRING", "STRING", ids.cache_key(c("t"), c("m"))),
        "lot_label": ("f STRING", "STRING", ids.lot_label(c("f"))),
        "sha1_uuid": ("n STRING", "STRING", ids.uuid5(c("n"))),
    }


HINTS = "hint_ord INT, parameter_hint STRING, value DOUBLE, unit STRING, start INT, end INT, source_text STRING"


def register(spark: SparkSession) -> list[str]:
    """Create the session's functions; returns their names."""
    from ..operators.hints import hint_array

    made = functions()
    for name, (parameters, result, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {sql_text(body)}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION hints(t STRING) RETURNS TABLE({HINTS}) RETURN SELECT h.* FROM (SELECT explode({sql_text(hint_array(F.col('t')))}) AS h)")
    spark.udf.register("cut_lines", X.cut_lines_udf(K.MAX_CHUNK_TOKENS * K.CHARS_PER_TOKEN))
    return [*made, "hints", "cut_lines"]
