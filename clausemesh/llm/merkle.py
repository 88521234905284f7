"""Document fingerprints: a Merkle tree over blocks, paragraphs and sections.

A text is cut at line breaks into paragraphs, and these into leaves: a leaf ends behind a word whose checksum is divisible
by LEAF_EVERY (or has MAX_WORDS words), so that an insertion moves no later border. Nothing is dropped by a cut, so the
leaves spell the text. A section is a run of paragraphs that ends with a blank one or with one whose digest is divisible by
SECTION_EVERY. The digest of a leaf is that of its words, the digest of a paragraph, a section and the root that of its
children's digests, all of 128 bits; so equal roots mean equal texts.

A fingerprint is the whole tree as text: root/section:paragraph leaf leaf,paragraph leaf;section:... with the root's 32 hex
digits and HEX of every other node, without blanks. Comparing two of them begins at the roots. Where these differ, sections of equal
digests are matched in order, then paragraphs in the gaps between them, then leaves in the gaps that are left; branches
that match are not entered. The likeness is the share of leaves that lie in matched branches (Dice), which a change of order
lowers; paragraphs without a match are where the edits are.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import key_id, partitions, small_batches

LEAF_EVERY, MAX_WORDS = 8, 64
SECTION_EVERY = 8
HEX = 10


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _short(digest: bytes) -> str:
    return digest.hex()[:HEX]


@dataclass
class Tree:
    """Digests as in the fingerprint: sections have paragraphs, these have leaves."""

    root: str
    sections: list[tuple[str, list[tuple[str, list[str]]]]]

    def __str__(self) -> str:
        return self.root + "/" + ";".join(s + ":" + ",".join(p + "".join(ls) for p, ls in ps) for s, ps in self.sections)


def _leaves(paragraph: bytes) -> list[bytes]:
    words = paragraph.split(b" ")
    ends = [i for i, w in enumerate(words, 1) if zlib.crc32(w) % LEAF_EVERY == 0]
    if not ends or ends[-1] != len(words):
        ends.append(len(words))
    out, begin = [], 0
    for end in ends:
        for at in range(begin, end, MAX_WORDS):
            out.append(_digest(b" ".join(words[at : min(at + MAX_WORDS, end)])))
        begin = end
    return out


def tree(text: str | None) -> Tree:
    """The tree of a whole text; a null is the empty text."""
    sections, whole, open_, digests = [], [], [], []

    def close() -> None:
        if open_:
            own = _digest(b"".join(digests))
            whole.append(own)
            sections.append((_short(own), list(open_)))
            open_.clear()
            digests.clear()

    for paragraph in (text or "").encode("utf-8").split(b"\n"):
        leaves = _leaves(paragraph)
        own = _digest(b"".join(leaves))
        digests.append(own)
        open_.append((_short(own), [_short(x) for x in leaves]))
        if not paragraph.strip() or own[0] % SECTION_EVERY == 0:
            close()
    close()
    return Tree(_digest(b"".join(whole)).hex(), sections)


def fingerprint(text: str | None) -> str:
    return str(tree(text))


def parsed(print_: str) -> Tree:
    """The tree of a fingerprint."""
    root, _, body = print_.partition("/")
    cut = lambda p: [p[i : i + HEX] for i in range(0, len(p), HEX)]
    sections = []
    for section in body.split(";"):
        name, _, paragraphs = section.partition(":")
        sections.append((name, [(c[0], c[1:]) for c in map(cut, paragraphs.split(","))]))
    return Tree(root, sections)


def in_order(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of equal entries of two lists, rising in both: of each entry the n-th occurrences belong together, and the
    longest rising run of these pairs stays."""
    places: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    pairs = [(i, places[x].pop()) for i, x in enumerate(a) if places.get(x)]
    tails, ends, before = [], [], [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        before[n] = ends[at - 1] if at else -1
        tails[at : at + 1], ends[at : at + 1] = [j], [n]
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def _gaps(a: list, b: list, key: Callable[[object], str]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
    """Matched places, and the ranges (a from, a to, b from, b to) between them."""
    match = in_order([key(x) for x in a], [key(x) for x in b])
    edges = [(-1, -1), *match, (len(a), len(b))]
    return match, [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if i + 1 < k and j + 1 < m]


def _aligned(a: Tree, b: Tree) -> tuple[int, list[bool]]:
    """How many leaves lie in matched branches, and for each paragraph of a whether it is matched."""
    flat = lambda sections: [p for _, ps in sections for p in ps]
    first, at = [], 0
    for _, ps in a.sections:
        first.append(at)
        at += len(ps)
    matched, leaves = [False] * at, 0
    same, gaps = _gaps(a.sections, b.sections, lambda s: s[0])
    for i, _ in same:
        own = a.sections[i][1]
        leaves += sum(len(ls) for _, ls in own)
        matched[first[i] : first[i] + len(own)] = [True] * len(own)
    for i, k, j, m in gaps:
        mine, theirs = flat(a.sections[i:k]), flat(b.sections[j:m])
        same, inner = _gaps(mine, theirs, lambda p: p[0])
        for x, _ in same:
            leaves += len(mine[x][1])
            matched[first[i] + x] = True
        for x, y, v, w in inner:
            leaves += len(in_order([h for _, ls in mine[x:y] for h in ls], [h for _, ls in theirs[v:w] for h in ls]))
    return leaves, matched


def _size(t: Tree) -> int:
    return sum(len(ls) for _, ps in t.sections for _, ls in ps)


def _like(a: Tree, b: Tree) -> float:
    return 1.0 if a.root == b.root else 2 * _aligned(a, b)[0] / (_size(a) + _size(b))


def _edits(a: Tree, b: Tree) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for i, same in enumerate(_aligned(a, b)[1] if a.root != b.root else []):
        if not same and out and out[-1][1] == i:
            out[-1] = (out[-1][0], i + 1)
        elif not same:
            out.append((i, i + 1))
    return out


def likeness(a: str, b: str) -> float:
    """Share of leaves that two fingerprints have in common, in order (Dice), found from the root downwards."""
    return _like(parsed(a), parsed(b))


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """Ranges [first, end) of paragraphs of a that have no match in b."""
    return _edits(parsed(a), parsed(b))


@F.pandas_udf(StringType())
def fingerprint_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(fingerprint, na_action=None)


# --- a document beside the next one --------------------------------------------------------------


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the key, by two short scans."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(r[0]) for r in rows])
    row = F.size(F.filter(heads, lambda b: b <= key))
    table = F.array(*[F.array(*[F.lit(b) for b in r]) for r in rows])
    return F.when(row == 0, 0).otherwise((row - 1) * step + F.size(F.filter(F.get(table, row - 1), lambda b: b <= key)))


def with_next(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k_id, k_h, text, role in partitions ordered by id: role 0 for each document; after the last of a partition
    comes a copy of the next partition's first document, with role 1 (after the last of all: the first of all).

    Borders are quantiles of the ids, one for each shuffle partition; the driver gets as many ids and nothing else.
    """
    rows = docs.select(key_id(id_col).alias("k_id"), F.xxhash64(F.col(text_col)).alias("k_h"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = partitions(spark)
    ids = docs.select(key_id(id_col).alias("k_id"))
    marks = ids.agg(F.percentile_approx("k_id", [i / n for i in range(1, n)] or [0.5], 10 * n)).first()[0] or []
    bounds = sorted(set(marks))
    bucket = _bucket(F.col("k_id"), bounds)
    firsts = {r[0]: r[1] for r in ids.groupBy(bucket.alias("b")).agg(F.min("k_id")).collect()}
    used = sorted(firsts)
    before = {b: used[i - 1] for i, b in enumerate(used)}  # the first of all goes behind the last
    of_bucket = lambda values, kind: F.get(F.array(*[F.lit(values.get(b)).cast(kind) for b in range(len(bounds) + 1)]), F.col("bucket"))
    rows = rows.withColumn("bucket", bucket)
    first = F.col("k_id") == of_bucket(firsts, "long")
    # the copies go in the same pass: a first document is sent to its own bucket and to the one before
    own = F.struct(F.lit(0).alias("role"), F.col("bucket").alias("to"))
    roles = F.when(first, F.array(own, F.struct(F.lit(1).alias("role"), of_bucket(before, "int").alias("to")))).otherwise(F.array(own))
    sent = rows.withColumn("r", F.explode(roles)).select("r.to", "r.role", "k_id", "k_h", "text")
    return sent.repartitionById(len(bounds) + 1, F.col("to").cast("int")).sortWithinPartitions("role", "k_id", "k_h")


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many, or all, of the first ones of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple | None = None
    print_of: Tree | None = None

    def row(one: tuple, own: Tree, following: str, theirs: Tree) -> tuple:
        changed = edited(one[1], following)
        other = own if changed == one[1] else theirs if changed == following else tree(changed)
        return (one[0], len(one[1]), hashlib.sha256(changed.encode("utf-8")).hexdigest(), str(own), str(other),
                _like(own, other), _like(own, theirs), ",".join(f"{x}-{y}" for x, y in _edits(own, other)))

    done = False
    for batch in batches:
        out = []
        for role, k, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist()):
            if done:
                break
            own = tree(text)
            if held is not None:
                out.append(row(held, print_of, text, own))
            held, print_of = (k, text), own
            done = role == 1
        columns = list(zip(*out)) or [()] * len(_RESULT)
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(columns, _RESULT)], names=[n for n, _ in _RESULT])


_RESULT = [("k_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
           ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edited_paragraphs", pa.string())]
_RESULT_SQL = "k_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_paragraphs string"


def fingerprints_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its fingerprint, that of its edited text, the likeness of its fingerprint to that and
    to the next document's, and the ranges of paragraphs that the edit touches.

    Null and empty texts are the empty text: 0 characters, all of them equal. Null ids come first, documents of one id
    in the order of their texts' hashes. A single document is its own next. An empty table gives no row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    return with_next(spark, docs, id_col, text_col).mapInArrow(_compare, _RESULT_SQL)
