"""Text measures and the loss-free cut used by the chunker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed as K

TokenCounter = Callable[[Column], Column]


def estimate_tokens(text: Column) -> Column:
    """One token per four characters, never below one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / K.CHARS_PER_TOKEN).cast("int"))


def strip(text: Column) -> Column:
    """Trim every Unicode white-space character from both ends."""
    return F.btrim(text, F.lit(K.SPACES))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def block_text(md_preview: Column, raw: Column) -> Column:
    """The preview when there is one, else the raw text."""
    return F.coalesce(F.nullif(md_preview, F.lit("")), raw)


def safe_join(left: Column, right: Column) -> Column:
    """False where joining would glue two halves of a word, number or number and unit."""
    pair = F.concat(F.right(left, F.lit(1)), F.left(right, F.lit(1)))
    return ~(F.coalesce(pair, F.lit("")).rlike(K.UNSAFE_JOIN))


def is_atomic(text: Column) -> Column:
    """A chunk is atomic when it has content and does not end in a digit."""
    return F.coalesce(F.right(F.rtrim(text, F.lit(K.SPACES)), F.lit(1)).rlike(r"^(?s)\P{Nd}$"), F.lit(False))


def table_headers(structured: Column, md_preview: Column) -> Column:
    """Cells of the first structured row, else of the first Markdown table row."""
    first = F.filter(F.get(structured, F.lit(0)), lambda c: c != "")
    lines = F.transform(F.split(strip(F.coalesce(md_preview, F.lit(""))), "\n"), strip)
    rows = F.filter(lines, lambda s: s.startswith("|") & ~s.contains("---"))
    cells = F.transform(
        rows, lambda s: F.filter(F.transform(F.split(s, r"\|"), strip), lambda c: c != "")
    )
    from_md = F.get(F.filter(cells, lambda c: F.size(c) > 0), F.lit(0))
    empty = F.array().cast("array<string>")
    return F.when(F.coalesce(F.size(structured), F.lit(0)) > 0, F.coalesce(first, empty)).otherwise(
        F.coalesce(from_md, empty)
    )


# --- cutting one over-long line ---------------------------------------------------


def _char_kinds(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per character: is it a digit, an ASCII letter, a place where a cut is harmless."""
    code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    letter = ((code | 32) >= 97) & ((code | 32) <= 122)
    digit = (code >= 48) & (code <= 57)
    safe = _ASCII_SAFE[np.minimum(code, 128)]
    if (code > 127).any():
        for low, high in K.CJK_CUT_RANGES:
            safe |= (code >= low) & (code <= high)
        for c in np.unique(code[code > 127]):
            if chr(c).isspace():
                safe |= code == c
            if chr(c).isdigit():
                digit |= code == c
    return digit, letter, safe


_ASCII_SAFE = np.array([chr(i) in K.ASCII_CUT_MARKS or chr(i).isspace() for i in range(128)] + [False])


def cut_line(text: str, limit: int) -> list[str]:
    """Cut a line into pieces of at most `limit` characters, dropping blank pieces.

    A cut that would fall inside a word or number moves left, within a window of a
    fifth of its absolute position, to the start of the number or past the closest
    harmless character.
    """
    if len(text) <= limit:
        return [text] if text else []
    digit, letter, safe = _char_kinds(text)
    dot = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) == ord(".")
    word = digit | letter
    numeric = digit | dot
    splits_word = word[:-1] & word[1:]
    splits_decimal = (digit[:-1] & dot[1:]) | (dot[:-1] & digit[1:])
    # last position <= i holding a harmless / a non-numeric character
    index = np.arange(len(text))
    last_safe = np.maximum.accumulate(np.where(safe, index, -1))
    last_other = np.maximum.accumulate(np.where(numeric, -1, index))
    pieces, start = [], 0
    while start < len(text):
        end = min(start + limit, len(text))
        if start + 1 < end < len(text) and (splits_word[end - 1] or splits_decimal[end - 1]):
            floor = max(0, end - max(K.LOOKBACK_MIN, int(end * K.LOOKBACK_SHARE)))
            before_number = max(int(last_other[end - 1]), floor)
            spot = int(last_safe[end - 1])
            if numeric[end - 1] and before_number + 1 < end and safe[before_number]:
                target = before_number + 1
            else:
                target = spot + 1 if spot >= floor else end
            if target > start:
                end = target
        if text[start:end].strip():
            pieces.append(text[start:end])
        start = end
    return pieces


def cut_lines_udf(limit: int):
    """Arrow UDF: every line of an array cut into its pieces, in order; a null line has none.

    Not marked deterministic: the optimizer then neither copies the call into filters nor
    moves it into a lambda, so each line is cut once.
    """

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def cut(lines: pd.Series) -> pd.Series:
        return lines.map(lambda ls: [] if ls is None else [[] if x is None else cut_line(x, limit) for x in ls])

    return cut.asNondeterministic()


def merge_fragments(
    fragments: Column, budget: int, counter: TokenCounter = estimate_tokens
) -> Column:
    """Greedy left-to-right merge within the budget, never across an unsafe boundary."""
    filled = F.filter(fragments, lambda f: ~is_blank(f))
    zero = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("string").alias("tail"),
        F.lit(0).alias("tokens"),
    )

    def step(acc: Column, frag: Column) -> Column:
        tokens = counter(frag).cast("int")
        fits = (
            acc.tail.isNotNull() & safe_join(acc.tail, frag) & (acc.tokens + tokens <= F.lit(budget))
        )
        return F.struct(
            F.when(fits | acc.tail.isNull(), acc.done)
            .otherwise(F.concat(acc.done, F.array(acc.text)))
            .alias("done"),
            F.when(fits, F.concat(acc.text, frag)).otherwise(frag).alias("text"),
            frag.alias("tail"),
            F.when(fits, acc.tokens + tokens).otherwise(tokens).alias("tokens"),
        )

    return F.aggregate(
        filled,
        zero,
        step,
        lambda a: F.when(a.text.isNull(), a.done).otherwise(F.concat(a.done, F.array(a.text))),
    )


def split_by_tokens(
    text: Column,
    max_tokens: int = K.MAX_CHUNK_TOKENS,
    counter: TokenCounter = estimate_tokens,
    cut_chars: int | None = None,
) -> Column:
    """Cut then merge one text: the stand-alone two-phase split."""
    pieces = F.get(cut_lines_udf(cut_chars or max_tokens * K.CHARS_PER_TOKEN)(F.array(text)), F.lit(0))
    return merge_fragments(pieces, max_tokens, counter)
