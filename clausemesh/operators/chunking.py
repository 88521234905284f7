"""Scope-aware chunking.

Work is laid out in units: the sorted blocks of one document, at most UNIT_BLOCKS of them.
Inside a unit everything is array expressions, so documents that arrive as one row are one unit, chunked without any shuffle. A document with more units gets two small carries per unit,
the scope before it and the tokens of the pack left open, worked out from per-unit
summaries; a pack that crosses a unit edge is put together afterwards by its own key.

The greedy packing of a unit is a function from the tokens carried in to the tokens
carried out. It is tabulated per unit (max_tokens + 1 entries), so units are summarised in
parallel and only the tables are composed in order.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed as K
from ..functions import ids
from ..functions import text as X
from ..session import cut_lineage
from .scan import Running, running, sorted_by, sorted_list

UNIT_BLOCKS = 1024
FAN = 512
DOC = ["doc_hash", "version"]
UNIT = [*DOC, "unit"]

BLOCK_FIELDS = [
    "block_ord", "block_id", "type", "scope", "page", "form_fields", "column_headers",
    "structured", "md_preview", "text",
]


def _flat(blocks: DataFrame, *keep: str) -> DataFrame:
    return blocks.select(
        *keep,
        "doc_hash",
        F.col("version").cast("int").alias("version"),
        F.col("doc_type"),
        F.col("block_ord").cast("long").alias("block_ord"),
        "block_id",
        "type",
        F.coalesce("metadata.heading_path", F.array().cast("array<string>")).alias("scope"),
        F.col("metadata.page_number").alias("page"),
        F.coalesce("metadata.form_fields", F.array().cast("array<map<string,string>>")).alias("form_fields"),
        F.coalesce(
            "metadata.column_headers", F.array().cast("array<struct<index:int,header:string>>")
        ).alias("column_headers"),
        F.col("content.structured").alias("structured"),
        F.col("content.md_preview").alias("md_preview"),
        X.block_text(F.col("content.md_preview"), F.col("content.raw")).alias("text"),
    )


_FILLED = "coalesce(text, '') <> ''"


def prepare_blocks(blocks: DataFrame) -> DataFrame:
    """Parsed blocks flattened to what chunking reads; blocks without text are dropped."""
    return _flat(blocks).where(_FILLED)


def unit_of(block_ord: Column) -> Column:
    return F.floor(block_ord / UNIT_BLOCKS)


def bundle_units(parsed: DataFrame) -> DataFrame:
    """Units of the output of parse_lines with bundle_id, doc_hash, version, doc_type, unit, alone and block_ord.

    `bad` is true where a line of the unit is rejected; such a unit has no blocks. There is no shuffle if the lines lie
    together by bundle_id and unit.
    """
    rows = _flat(parsed, "bundle_id", "unit", "alone", "bad").groupBy("bundle_id", *UNIT).agg(
        F.first("doc_type").alias("doc_type"), F.first("alone").alias("alone"), F.bool_or("bad").alias("bad"),
        sorted_list("block_ord", *BLOCK_FIELDS, where=~F.col("bad") & F.expr(_FILLED)).alias("rows"),
    )
    return rows.withColumn("rows", F.when(F.col("bad"), F.slice("rows", 1, 0)).otherwise(F.col("rows")))


def joined_units(units: DataFrame) -> DataFrame:
    """Units of equal document, version and number put together, such as those of several bundles of one document."""
    return units.groupBy(*UNIT).agg(F.first("doc_type").alias("doc_type"), sorted_by("block_ord", F.flatten(F.collect_list("rows"))).alias("rows")).where(F.size("rows") > 0)


def units_from_blocks(prepared: DataFrame) -> DataFrame:
    """One row per document and run of UNIT_BLOCKS block positions: the only shuffle of text."""
    return (
        prepared.withColumn("unit", unit_of(F.col("block_ord")))
        .groupBy(*UNIT)
        .agg(
            F.first("doc_type").alias("doc_type"),
            sorted_list("block_ord", *BLOCK_FIELDS).alias("rows"),
        )
    )


def units_from_texts(
    docs: DataFrame, doc_hash: Column, version: Column, doc_type: Column, scope: Column, text: Column
) -> DataFrame:
    """Plain texts as units, one block per line, with no shuffle.

    A text that is one row is one unit whatever its length. The page of every block is 1
    and its identifier its position.
    """
    lines = F.split(text, "\n")
    blocks = F.filter(
        F.transform(
            lines,
            lambda line, i: F.struct(
                i.cast("long").alias("block_ord"),
                F.concat(F.lit("b"), i.cast("string")).alias("block_id"),
                F.lit("text").alias("type"),
                scope.alias("scope"),
                F.lit(1).alias("page"),
                F.array().cast("array<map<string,string>>").alias("form_fields"),
                F.array().cast("array<struct<index:int,header:string>>").alias("column_headers"),
                F.lit(None).cast("array<array<string>>").alias("structured"),
                F.lit(None).cast("string").alias("md_preview"),
                line.alias("text"),
            ),
        ),
        lambda b: b.text != "",
    )
    return docs.select(
        doc_hash.alias("doc_hash"),
        version.cast("int").alias("version"),
        doc_type.alias("doc_type"),
        F.lit(0).cast("long").alias("unit"),
        blocks.alias("rows"),
    ).where(text != "")


# --- packing ----------------------------------------------------------------------


def _packs(tokens: np.ndarray, fresh: np.ndarray, single: np.ndarray, carried: int, budget: int):
    """Start positions of packs. `fresh` rows open a pack, `single` rows stand alone.

    Returns (starts, tokens left open at the end). A first start above 0 means the rows
    before it continue the pack carried in.
    """
    n = len(tokens)
    total = np.concatenate(([0], np.cumsum(tokens)))
    alone = single | (tokens > budget)
    edges = np.flatnonzero(fresh | alone)
    starts: list[int] = []
    at, base = 0, -carried
    if n and (carried == 0 or fresh[0] or alone[0] or carried + tokens[0] > budget):
        starts.append(0)
        base = 0
    while True:
        if starts and alone[at]:
            nxt = at + 1
        else:
            over = int(np.searchsorted(total, base + budget, side="right")) - 1
            edge = int(np.searchsorted(edges, at, side="right" if starts else "left"))
            nxt = min(max(over, at + (1 if starts else 0)), int(edges[edge]) if edge < len(edges) else n)
        if nxt >= n:
            break
        starts.append(nxt)
        at, base = nxt, total[nxt]
    if n and starts and alone[starts[-1]] and starts[-1] == n - 1:
        return starts, 0
    return starts, int(total[n] - base) if n else carried


PACK_TYPE = T.ArrayType(T.IntegerType())


def pack_starts_udf(budget: int):
    """Arrow UDF over _packs. Not marked deterministic, so that the optimizer evaluates it once."""

    @F.pandas_udf(PACK_TYPE)
    def starts(tokens: pd.Series, fresh: pd.Series, single: pd.Series, carried: pd.Series) -> pd.Series:
        return pd.Series(
            [
                _packs(np.asarray(t, dtype=np.int64), np.asarray(f, dtype=bool), np.asarray(s, dtype=bool), int(c), budget)[0]
                for t, f, s, c in zip(tokens, fresh, single, carried)
            ]
        )

    return starts.asNondeterministic()


def carry_table_udf(budget: int):
    """Tokens left open after the unit, and the last pack start (-1: none), per tokens carried in."""

    @F.pandas_udf("struct<open array<int>, start array<int>>")
    def table(tokens: pd.Series, fresh: pd.Series, single: pd.Series) -> pd.DataFrame:
        opens, begins = [], []
        for t, f, s in zip(tokens, fresh, single):
            t, f, s = np.asarray(t, dtype=np.int64), np.asarray(f, dtype=bool), np.asarray(s, dtype=bool)
            by_first: dict[int, tuple[int, int]] = {}
            o, b = [], []
            edges = np.flatnonzero(f | s | (t > budget))
            first_edge = int(edges[0]) if len(edges) else len(t)
            total = np.concatenate(([0], np.cumsum(t)))
            for carried in range(budget + 1):
                first = 0 if carried == 0 else min(int(np.searchsorted(total, budget - carried, side="right")) - 1, first_edge)
                if first >= len(t):
                    o.append(int(carried + total[-1]))
                    b.append(-1)
                    continue
                if first not in by_first:
                    starts, left = _packs(t[first:], f[first:], s[first:], 0, budget)
                    by_first[first] = (left, first + starts[-1])
                left, begin = by_first[first]
                o.append(left)
                b.append(begin)
            opens.append(o)
            begins.append(b)
        return pd.DataFrame({"open": opens, "start": begins})

    return table


def _with_breaks(units: DataFrame, counter: X.TokenCounter) -> DataFrame:
    """tokens / fresh / single arrays of a unit; `before` is the last block of the unit before."""
    is_single = lambda b: b.type.isin("table", "kv")
    rows = F.col("rows")
    prev = lambda i: F.when(i == 0, F.col("before")).otherwise(
        F.struct(
            F.get(rows, i - 1).getField("scope").alias("scope"),
            is_single(F.get(rows, i - 1)).alias("single"),
        )
    )
    return units.withColumns(
        {
            "tokens": F.transform(rows, lambda b: counter(b.text).cast("int")),
            "single": F.transform(rows, lambda b: is_single(b)),
            "fresh": F.transform(
                rows,
                lambda b, i: is_single(b)
                | prev(i).isNull()
                | F.coalesce(prev(i).getField("single") | (prev(i).getField("scope") != b.scope), F.lit(False)),
            ),
        }
    )


_BEFORE = "struct<scope:array<string>,single:boolean>"


def _carry_free(units: DataFrame) -> DataFrame:
    return units.withColumns(
        {
            "before": F.lit(None).cast(_BEFORE),
            "after": F.lit(None).cast(_BEFORE),
            "carried": F.lit(0),
            "carried_key": F.lit(None).cast("long"),
            "more": F.lit(False),
        }
    )


def _with_carry(units: DataFrame, budget: int, counter: X.TokenCounter) -> DataFrame:
    """Carries between the units of one document, from summaries only.

    Unit tables are composed in groups of FAN units, group tables in order per document,
    and the states found are pushed back down, so the longest ordered fold is over groups.
    """
    edge = lambda b: F.struct(
        b.getField("scope").alias("scope"), b.getField("type").isin("table", "kv").alias("single")
    )
    ends = units.select(
        *UNIT, edge(F.get("rows", F.lit(0))).alias("head"), edge(F.element_at("rows", -1)).alias("tail")
    )
    by_unit = W.partitionBy(*DOC).orderBy("unit")
    near = ends.select(
        *UNIT, F.lag("tail").over(by_unit).alias("before"), F.lead("head").over(by_unit).alias("after")
    )
    rows = _with_breaks(units.join(near, UNIT, "left"), counter)
    grouped = (
        rows.select(
            *UNIT,
            F.col("after").isNotNull().alias("more"),
            carry_table_udf(budget)("tokens", "fresh", "single").alias("t"),
        )
        .groupBy(*DOC, F.floor(F.col("unit") / FAN).alias("g"))
        .agg(F.sort_array(F.collect_list(F.struct("unit", "t.open", "t.start", "more"))).alias("us"))
    )
    key_of = lambda u, state, old: F.when(F.get(u.start, state) < 0, old).otherwise(
        u.unit * UNIT_BLOCKS + F.get(u.start, state)
    )
    blank = F.struct(
        F.sequence(F.lit(0), F.lit(budget)).alias("open"),
        F.array_repeat(F.lit(-1).cast("long"), budget + 1).alias("key"),
    )
    composed = grouped.select(
        *DOC,
        "g",
        F.when(
            F.element_at("us", -1).getField("more"),
            F.aggregate(
                "us",
                blank,
                lambda acc, u: F.struct(
                    F.transform(acc.open, lambda s: F.get(u.open, s)).alias("open"),
                    F.zip_with(acc.open, acc.key, lambda s, k: key_of(u, s, k)).alias("key"),
                ),
            ),
        ).alias("t"),
    )

    def walk(items: Column, at, start: Column, step_key) -> Column:
        """States before every item of an ordered list of tables."""
        return F.aggregate(
            items,
            F.struct(
                start.getField("carried").alias("carried"),
                start.getField("carried_key").alias("key"),
                F.array().cast("array<struct<at:bigint,carried:int,carried_key:bigint>>").alias("out"),
            ),
            lambda acc, u: F.struct(
                F.get(u.open, acc.carried).alias("carried"),
                step_key(u, acc.carried, acc.key).alias("key"),
                F.concat(
                    acc.out,
                    F.array(
                        F.struct(at(u).alias("at"), acc.carried.alias("carried"), acc.key.alias("carried_key"))
                    ),
                ).alias("out"),
            ),
            lambda acc: acc.out,
        )

    zero = F.struct(F.lit(0).alias("carried"), F.lit(-1).cast("long").alias("carried_key"))
    group_key = lambda u, state, old: F.when(F.get(u.key, state) < 0, old).otherwise(
        F.get(u.key, state)
    )
    group_states = (
        composed.groupBy(*DOC)
        .agg(F.sort_array(F.collect_list(F.struct("g", "t.open", "t.key"))).alias("gs"))
        .select(*DOC, F.explode(walk(F.col("gs"), lambda u: u.g, zero, group_key)).alias("o"))
        .select(*DOC, F.col("o.at").alias("g"), F.struct("o.carried", "o.carried_key").alias("entry"))
    )
    states = (
        grouped.join(group_states, [*DOC, "g"])
        .select(*DOC, F.explode(walk(F.col("us"), lambda u: u.unit, F.col("entry"), key_of)).alias("o"))
        .select(*DOC, F.col("o.at").alias("unit"), "o.carried", "o.carried_key")
    )
    return (
        units.join(near, UNIT, "left")
        .join(states, UNIT, "left")
        .withColumn("more", F.col("after").isNotNull())
        .withColumn("carried", F.coalesce("carried", F.lit(0)))
    )


def _packed(units: DataFrame, budget: int, counter: X.TokenCounter, keep: Sequence[str] = ()) -> DataFrame:
    """Array column `packs` of STRUCT<key, edge, kind, blocks>, one per pack piece in the unit.

    kind: single (table or kv), split (one block over budget), flush (closed by a table or
    the end of the document: emitted whole), route (closed by scope change or budget), and
    open (continues in the next unit). edge marks pieces of packs that cross units.
    """
    marked = _with_breaks(units, counter).withColumn(
        "starts", pack_starts_udf(budget)("tokens", "fresh", "single", "carried")
    )
    n = F.size("rows")
    continues = F.coalesce(F.get("starts", F.lit(0)), n) != 0
    starts = F.when(continues, F.concat(F.array(F.lit(0)), "starts")).otherwise(F.col("starts"))

    def piece(start: Column, i: Column) -> Column:
        end = F.coalesce(F.get(F.col("all_starts"), i + 1), n)
        left_over = F.col("continues") & (i == 0)
        at_end = end == n
        single = F.get("single", start) & ~left_over
        split = (F.get("tokens", start) > budget) & ~left_over
        next_single = F.when(at_end, F.coalesce(F.col("after.single"), F.lit(False))).otherwise(
            F.coalesce(F.get("single", end), F.lit(False))
        )
        next_scope = F.when(at_end, F.col("after.scope")).otherwise(F.get("rows", end).getField("scope"))
        scope_end = F.coalesce(next_scope != F.get("rows", end - 1).getField("scope"), F.lit(False))
        kind = (
            F.when(single, F.lit("single"))
            .when(split, F.lit("split"))
            .when(at_end & ~F.col("more"), F.lit("flush"))
            .when(next_single, F.lit("flush"))
            .when(at_end & ~scope_end, F.lit("open"))
            .otherwise(F.lit("route"))
        )
        return F.struct(
            F.when(left_over, F.col("carried_key")).otherwise(F.col("unit") * UNIT_BLOCKS + start).alias("key"),
            (left_over | (kind == "open")).alias("edge"),
            kind.alias("kind"),
            F.slice("rows", start + 1, end - start).alias("blocks"),
        )

    return (
        marked.withColumns({"continues": continues, "all_starts": starts})
        .select(*DOC, "doc_type", "unit", *keep, F.transform("all_starts", piece).alias("packs"))
    )


# --- from packs to chunk texts ------------------------------------------------------


def _unsafe(texts: Column) -> Column:
    follow = F.slice(texts, F.lit(2), F.greatest(F.size(texts) - 1, F.lit(0)))
    return F.exists(
        F.zip_with(F.slice(texts, F.lit(1), F.size(follow)), follow, X.safe_join), lambda safe: ~safe
    )


def row_groups_udf(budget: int):
    """Groups of table rows within the character budget, with the header counted in.

    Per table, each group is [first, count, over]: over = 1 marks one row above the budget;
    count = 0 is a header on its own, which precedes such a row when no row is waiting.
    """

    def one(sizes, head: int) -> list[list[int]]:
        limit = budget * K.CHARS_PER_TOKEN
        out, first, count, used = [], 0, 0, head
        for i, size in enumerate(sizes):
            if max(1, size // K.CHARS_PER_TOKEN) > budget:
                if count or head:
                    out.append([first, count, 0])
                out.append([i, 1, 1])
                first, count = i + 1, 0
                continue
            if count and used + size + 1 > limit:
                out.append([first, count, 0])
                first, count, used = i, 0, head
            count, used = count + 1, used + size + 1
        if count:
            out.append([first, count, 0])
        return out

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.ArrayType(T.IntegerType()))))
    def groups(lengths: pd.Series, headers: pd.Series) -> pd.Series:
        return pd.Series(
            [[one(s, int(h)) for s, h in zip(ls, hs)] for ls, hs in zip(lengths, headers)], dtype=object
        )

    return groups.asNondeterministic()


def _first_filled(blocks: Column, field: str) -> Column:
    return F.coalesce(
        F.get(F.filter(F.transform(blocks, lambda b: b.getField(field)), lambda v: F.size(v) > 0), F.lit(0)),
        F.get(F.transform(blocks, lambda b: b.getField(field)), F.lit(0)),
    )


def _chunk_arrays(rows: DataFrame, budget: int, counter: X.TokenCounter, with_tables: bool) -> DataFrame:
    """Add `chunks`, the ordered chunk texts of the packs in a row, with their metadata."""
    limit = budget * K.CHARS_PER_TOKEN
    head = lambda p: F.get(p.blocks, F.lit(0))
    big_table = lambda p: (
        (p.kind == "single")
        & (head(p).getField("type") == "table")
        & (F.coalesce(F.size(head(p).getField("structured")), F.lit(0)) > 0)
        & (X.estimate_tokens(head(p).getField("text")) > budget)
    )
    if with_tables:
        tables = F.filter("packs", big_table)
        rows = rows.withColumns(
            {
                "table_lines": F.transform(
                    tables,
                    lambda p: F.transform(
                        F.slice(head(p).getField("structured"), F.lit(2), F.size(head(p).getField("structured"))),
                        lambda r: F.array_join(r, " | ", "None"),
                    ),
                ),
                "table_heads": F.transform(
                    F.transform(
                        tables, lambda p: X.table_headers(head(p).getField("structured"), head(p).getField("md_preview"))
                    ),
                    lambda h: F.when(F.size(h) > 0, F.concat(F.array_join(h, " | "), F.lit("\n"))).otherwise(F.lit("")),
                ),
            }
        ).withColumn(
            "table_groups",
            row_groups_udf(budget)(
                F.transform("table_lines", lambda ls: F.transform(ls, lambda s: F.length(s))),
                F.transform("table_heads", lambda s: F.length(s)),
            ),
        )

    # staged so that every value of a pack is worked out once: a lambda variable is bound, not inlined
    facts = F.transform(
        "packs",
        lambda p: F.struct(
            p.kind.alias("kind"),
            head(p).getField("text").alias("whole"),
            F.array_join(F.transform(p.blocks, lambda b: b.text), "\n").alias("full"),
            _unsafe(F.when(p.kind == "route", F.transform(p.blocks, lambda b: b.text))).alias("unsafe"),
            head(p).getField("scope").alias("scope_path"),
            F.transform(p.blocks, lambda b: b.block_id).alias("source_block_ids"),
            F.array_distinct(F.transform(p.blocks, lambda b: b.page)).alias("pages"),
            _first_filled(p.blocks, "form_fields").alias("form_fields"),
            _first_filled(p.blocks, "column_headers").alias("column_headers"),
        ),
    )
    part_type = "array<struct<text:string,warn:boolean,cut:boolean>>"

    def part(text: Column, cut: Column, warn: bool = False) -> Column:
        return F.struct(text.alias("text"), F.lit(warn).alias("warn"), cut.alias("cut"))

    def plain_parts(a: Column) -> Column:
        big = X.estimate_tokens(a.whole) > budget
        routed = (a.kind == "route") & (F.coalesce(a.unsafe, F.lit(False)) | (counter(a.full) > budget))
        cut = (a.kind == "split") | routed
        return F.when(a.kind == "single", part(a.whole, big)).otherwise(
            part(F.when(cut, a.full).otherwise(X.strip(a.full)), cut)
        )

    def table_parts(i: Column) -> Column:
        nth = F.size(F.filter(F.slice("packs", F.lit(1), i + 1), big_table)) - 1
        buffers = F.transform(
            F.get("table_groups", nth),
            lambda g: F.struct(
                (F.get(g, F.lit(2)) == 1).alias("lone"),
                F.slice(F.get("table_lines", nth), F.get(g, F.lit(0)) + 1, F.get(g, F.lit(1))).alias("body"),
            ),
        )
        joined = F.transform(
            buffers,
            lambda g: F.struct(
                g.lone.alias("warn"),
                F.when(g.lone, F.array_join(g.body, "\n"))
                .otherwise(
                    X.strip(F.array_join(F.filter(F.concat(F.array(F.get("table_heads", nth)), g.body), lambda s: s != ""), "\n"))
                )
                .alias("text"),
            ),
        )
        return F.transform(
            joined,
            lambda g: F.struct(
                g.text.alias("text"), g.warn.alias("warn"), (g.warn | (X.estimate_tokens(g.text) > budget)).alias("cut")
            ),
        )

    def lines_of(a: Column, parts: Column) -> Column:
        line = lambda q, text, cut: F.struct(
            text.alias("text"), q.warn.alias("quality_warning"), cut.alias("cut"), a.scope_path.alias("scope_path"),
            a.source_block_ids.alias("source_block_ids"),
            F.when(q.cut | (a.kind == "single"), a.pages).otherwise(F.array_sort(a.pages)).alias("page_numbers"),
            a.form_fields.alias("form_fields"), a.column_headers.alias("column_headers"),
        )
        return F.flatten(
            F.transform(
                F.filter(parts, lambda q: F.coalesce(q.text, F.lit("")) != ""),
                lambda q: F.when(
                    q.cut,
                    F.transform(
                        F.filter(F.split(q.text, "\n"), lambda s: ~X.is_blank(s)),
                        lambda s: line(q, s, F.length(s) > limit),
                    ),
                ).otherwise(F.array(line(q, q.text, F.lit(False)))),
            )
        )

    def lines(a: Column, i: Column) -> Column:
        parts = F.array(plain_parts(a)).cast(part_type)
        if with_tables:
            found = big_table(F.get("packs", i)) & (F.size("table_groups") > 0)
            parts = F.when(found, table_parts(i)).otherwise(parts)
        return lines_of(a, parts)

    rows = rows.withColumn("lines", F.flatten(F.transform(facts, lines)))
    # a place for each line, so that a line's pieces are found by its number
    texts = F.transform("lines", lambda s: F.when(s.cut, s.text))
    wanted = F.when(F.exists("lines", lambda s: s.cut), texts).otherwise(F.array().cast("array<string>"))
    out = rows.withColumn("pieces", X.cut_lines_udf(limit)(wanted))
    merged = F.flatten(
        F.transform(
            "lines",
            lambda s, i: F.when(
                s.cut,
                F.transform(
                    X.merge_fragments(F.get("pieces", i), budget, counter),
                    lambda t: s.withField("text", t),
                ),
            ).otherwise(F.array(s)),
        )
    )
    # two references keep the optimizer from moving the Arrow UDF into the lambda
    return out.withColumn("chunks", F.when(F.size("pieces") == 0, F.col("lines")).otherwise(merged))


CHUNK_COLUMNS = [
    *DOC, "doc_type", "chunk_index", "chunk_id", "text", "scope_path", "source_block_ids", "token_count",
    "page_numbers", "form_fields", "column_headers", "quality_warning",
]


def _finish(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Explode `chunks` numbered from `offset` into the chunk table; with columns to keep, rows without chunks stay, too."""
    rows = df.select(*DOC, "doc_type", "offset", *keep, F.posexplode_outer("chunks").alias("pos", "c"))
    return (
        (rows if keep else rows.where(F.col("pos").isNotNull()))
        .select(*DOC, "doc_type", (F.col("offset") + F.col("pos")).alias("chunk_index"), *keep, "c.*")
        .withColumns(
            {
                "chunk_id": ids.chunk_id(F.col("doc_hash"), F.col("chunk_index")),
                "token_count": X.estimate_tokens(F.col("text")),
            }
        )
        .select(*keep, *CHUNK_COLUMNS)
    )


def pack_units(
    units: DataFrame, max_tokens: int = K.MAX_CHUNK_TOKENS, counter: X.TokenCounter = X.estimate_tokens, keep: Sequence[str] = ()
) -> DataFrame:
    """Packs of documents that are one unit each, before their texts are built."""
    return _packed(_carry_free(units), max_tokens, counter, keep)


def chunk_single_units(
    units: DataFrame,
    max_tokens: int = K.MAX_CHUNK_TOKENS,
    counter: X.TokenCounter = X.estimate_tokens,
    with_tables: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Chunk documents that are one unit each: a narrow plan from scan to chunks.

    With columns of the units to keep, a document without chunks has one row, whose chunk_index is null.
    """
    packed = pack_units(units, max_tokens, counter, keep)
    return _finish(_chunk_arrays(packed, max_tokens, counter, with_tables).withColumn("offset", F.lit(0).cast("long")), keep)


def chunk_unit_series(
    units: DataFrame,
    max_tokens: int = K.MAX_CHUNK_TOKENS,
    counter: X.TokenCounter = X.estimate_tokens,
    with_tables: bool = True,
) -> DataFrame:
    """Chunk documents of any number of units."""
    packs = _packed(_with_carry(units, max_tokens, counter), max_tokens, counter).select(
        *DOC, "doc_type", "unit", F.explode("packs").alias("p")
    ).select(*DOC, "doc_type", "unit", "p.*")
    joined = (
        packs.where("edge")
        .groupBy(*DOC, "doc_type", "key")
        .agg(sorted_list("unit", "unit", "kind", "blocks").alias("ps"))
        .select(
            *DOC, "doc_type", "key",
            # still open at its last unit: the next unit started afresh, so the budget closed it
            F.when(F.element_at("ps", -1).getField("kind") == "open", F.lit("route"))
            .otherwise(F.element_at("ps", -1).getField("kind"))
            .alias("kind"),
            F.flatten(F.transform("ps", lambda p: p.blocks)).alias("blocks"),
        )
    )
    all_packs = packs.where(~F.col("edge")).select(*joined.columns).unionByName(joined)
    chunked = cut_lineage(
        _chunk_arrays(
            all_packs.select(*DOC, "doc_type", "key", F.array(F.struct("key", "kind", "blocks")).alias("packs")),
            max_tokens, counter, with_tables,
        ).select(*DOC, "doc_type", "key", "chunks")
    )
    counts = chunked.select(*DOC, "key", F.size("chunks").cast("long").alias("n"))
    offsets = running(counts, DOC, [F.col("key")], {"offset": Running("sum", F.col("n"), inclusive=False)})
    numbered = chunked.join(
        offsets.select(*DOC, "key", F.coalesce("offset", F.lit(0).cast("long")).alias("offset")), [*DOC, "key"]
    )
    return _finish(numbered)


def chunk_blocks(
    blocks: DataFrame,
    max_tokens: int = K.MAX_CHUNK_TOKENS,
    counter: X.TokenCounter = X.estimate_tokens,
) -> DataFrame:
    """Chunk a table of parsed blocks: doc_hash, version, doc_type, block_ord and the block.

    Documents above UNIT_BLOCKS positions are found first, from two columns; without any,
    the plan is the one shuffle that gathers a document's blocks.
    """
    prepared = prepare_blocks(blocks)
    units = units_from_blocks(prepared)
    long_docs = cut_lineage(prepared.where(F.col("block_ord") >= UNIT_BLOCKS).select(*DOC).distinct())
    if long_docs.isEmpty():
        return chunk_single_units(units, max_tokens, counter)
    short = chunk_single_units(units.join(long_docs, DOC, "left_anti"), max_tokens, counter)
    return short.unionByName(chunk_unit_series(units.join(long_docs, DOC, "left_semi"), max_tokens, counter))


def chunk_texts(
    docs: DataFrame,
    doc_hash: Column,
    version: Column,
    doc_type: Column,
    scope: Column,
    text: Column,
    max_tokens: int = K.MAX_CHUNK_TOKENS,
    counter: X.TokenCounter = X.estimate_tokens,
) -> DataFrame:
    """Chunk plain texts, a block per line, with no shuffle."""
    units = units_from_texts(docs, doc_hash, version, doc_type, scope, text)
    return chunk_single_units(units, max_tokens, counter, with_tables=False)
