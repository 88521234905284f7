"""Line dedup with a suffix array over line ids, built by distributed prefix doubling.

Every line has an id, its rank among the lines that occur more than once; the text of a document is the sequence of its
line ids. After round k a suffix has the rank of its first 2^k lines among all suffixes, so suffixes of equal rank are
one interval of the suffix array whose common prefix has at least 2^k lines. A round pairs the rank at i with the rank
at i + 2^k, and orders the pairs inside their old interval. Suffixes alone in their interval are done and leave, so
rounds shrink quickly. The interval for any other length m is named by two overlapping ranks, of the 2^k lines at the
start and of the 2^k lines that end the m.

Runs: a run of lines of one document counts when it has `min_words` words or more; if the same run occurs earlier
(by document id, then line), the later copy's lines are deleted. Every maximal such run is the union of the shortest
runs of `min_words` words that begin or end at its lines, and these are what is looked up, so that no list of matches
per suffix is needed.

DataFrame functions only. Text is read twice and shuffled once, to put the kept lines together; all other shuffles hold
numbers. Ranks inside an interval are counted in buckets, so one line that begins a third of all runs is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import key_id, keyed, unused

MIN_WORDS = 50
WORD = r"[^ \t\r\x0B\f]+"
RANK_BUCKET = 1 << 16
_DOC = ["k_id", "k_h"]


def _lines(docs: DataFrame) -> DataFrame:
    """k_id, k_h, pos, two 64-bit hashes of the line and its number of words; once for equal documents."""
    rows = docs.select("k_id", "k_h", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    rows = rows.select(*_DOC, "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"), F.regexp_count("line", F.lit(WORD)).alias("words"))
    return rows.repartition(*_DOC).dropDuplicates([*_DOC, "pos"])


def _shortest_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """For every line the last line of the shortest run that begins with it, and the first of the one that ends with it
    (null: too few words)."""
    doc = W.partitionBy(*_DOC)
    so_far = F.sum("words").over(doc.orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = lines.withColumn("after", so_far.cast("long")).withColumn("before", F.col("after") - F.col("words"))
    ahead = doc.orderBy("before").rangeBetween(0, min_words - 1)
    back = doc.orderBy("after").rangeBetween(-(min_words - 1), 0)
    rows = rows.withColumns({"to": F.max("pos").over(ahead), "to_after": F.max("after").over(ahead)})
    rows = rows.withColumns({"from": F.min("pos").over(back), "from_before": F.min("before").over(back)})
    return rows.select(
        *_DOC, "pos", "h1", "h2",
        F.when(F.col("to_after") - F.col("before") >= min_words, F.col("to")).alias("to"),
        F.when(F.col("after") - F.col("from_before") >= min_words, F.col("from")).alias("from"),
    )


def _sums_before(df: DataFrame, group: list[str], bucket: Column, order: list[str], n: str, out: str) -> DataFrame:
    """Add the sum of n over the rows of the group that come before in order. Buckets follow the order; sums over whole
    buckets and inside the bucket are two windows, each over a bounded number of rows."""
    rows = df.withColumn("_bucket", bucket)
    sums = rows.groupBy(*group, "_bucket").agg(F.sum(n).alias("_n"))
    sums = sums.withColumn("_base", F.coalesce(F.sum("_n").over(W.partitionBy(*(group or [F.lit(0)])).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = W.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    rows = rows.join(sums.drop("_n"), [*group, "_bucket"])
    return rows.withColumn(out, F.col("_base") + F.col("_inside")).drop("_bucket", "_base", "_inside")


def line_ids(runs: DataFrame) -> DataFrame:
    """Rank of every line that occurs more than once: h1, h2, rank. Lines are ordered by their hashes; equal lines share
    the number of lines before them."""
    repeated = runs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _sums_before(repeated, [], F.shiftright("h1", 50), ["h1", "h2"], "n", "rank").select("h1", "h2", "rank")


def doubled(ranks: DataFrame, length: int) -> DataFrame:
    """One round of prefix doubling: ranks of `length` lines (k_id, k_h, pos, rank) to ranks of twice as many; suffixes
    that are alone in their interval, or shorter, leave."""
    ahead = W.partitionBy(*_DOC).orderBy("pos").rangeBetween(length, length)
    pairs = ranks.withColumn("next", F.max("rank").over(ahead)).where("next is not null")
    kinds = pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    kinds = _sums_before(kinds, ["rank"], F.expr(f"next div {RANK_BUCKET}"), ["next"], "n", "less").select("rank", "next", (F.col("rank") + F.col("less")).alias("finer"))
    return pairs.join(kinds, ["rank", "next"]).select(*_DOC, "pos", F.col("finer").alias("rank"))


def _later_copies(wanted: DataFrame, ranks: DataFrame, length: int) -> DataFrame:
    """Of the wanted runs (k_id, k_h, pos, m), length <= m < 2 * length, those that occur earlier."""
    runs = wanted.where((F.col("m") >= length) & (F.col("m") < 2 * length)).withColumn("tail", F.col("pos") + F.col("m") - length)
    ends = ranks.select(*_DOC, F.col("pos").alias("tail"), F.col("rank").alias("rank_b"))
    runs = runs.join(ranks, [*_DOC, "pos"]).join(ends, [*_DOC, "tail"])
    place = F.struct(*_DOC, "pos")
    same = runs.groupBy("m", "rank", "rank_b").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    return runs.join(same, ["m", "rank", "rank_b"]).where(place > F.col("first")).select(*_DOC, "pos", "m")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """k_id, k_h, removed: the sorted positions of the lines to delete, for the documents that have any.

    Null and empty texts have no run of min_words words and lose nothing; equal documents (same id and text) are one;
    the order between documents of one id is by the hash of their texts.
    """
    if min_words < 1:
        raise ValueError("min_words must be 1 at least")
    runs = cut_lineage(_shortest_runs(_lines(keyed(docs, id_col, text_col)), min_words))
    ids = line_ids(runs)
    placed = cut_lineage(runs.join(ids, ["h1", "h2"]).select(*_DOC, "pos", "rank", "to", "from"))
    ahead = placed.where("`to` is not null").select(*_DOC, "pos", (F.col("to") - F.col("pos") + 1).alias("m"))
    back = placed.where("`from` is not null").select(*_DOC, F.col("from").alias("pos"), (F.col("pos") - F.col("from") + 1).alias("m"))
    wanted = cut_lineage(ahead.union(back).distinct())
    longest = wanted.agg(F.max("m")).first()[0] or 0
    ranks, length, found = placed.select(*_DOC, "pos", "rank"), 1, None
    while length <= longest:
        later = _later_copies(wanted, ranks, length)
        found = later if found is None else found.union(later)
        if 2 * length <= longest:
            ranks = cut_lineage(doubled(ranks, length))
        length *= 2
    if found is None:
        found = wanted
    lines = found.select(*_DOC, F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("m") - 1)).alias("pos"))
    return lines.groupBy(*_DOC).agg(F.sort_array(F.collect_set("pos")).alias("removed"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, n_lines: str = "n_lines", n_removed: str = "n_removed"
) -> DataFrame:
    """The documents without later copies of repeated runs, and their numbers of lines before and of lines removed.

    All columns and rows stay; a text of which every line is removed becomes empty, a null stays null (0 lines). New
    columns get a trailing underscore where docs has their name.
    """
    n_lines, n_removed, a, b, c = unused(docs, n_lines, n_removed, "_id", "_hash", "_removed")
    gone = repeated_lines(docs, id_col, text_col, min_words).select(F.col("k_id").alias(a), F.col("k_h").alias(b), F.col("removed").alias(c))
    rows = docs.withColumns({a: key_id(id_col), b: F.xxhash64(F.col(text_col))}).join(gone, [a, b], "left")
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(c)), lambda i: F.get(lines, i))
    rows = rows.withColumns({
        n_lines: F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long"),
        n_removed: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long"),
        text_col: F.when(F.col(c).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")),
    })
    return rows.select(*docs.columns, n_lines, n_removed)
