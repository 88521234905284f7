"""Secret scans over an incremental ledger of blobs.

Every version of a text is named by the SHA-256 of its content. The ledger holds, for each blob and rule version, the
spans found (an empty list if none), so the row itself says that the pair has been scanned. An update scans only the
pairs the ledger lacks, whatever paths or versions the blobs come from, appends them in one write, and findings are
joined back to all paths of a blob. A new rule version scans all blobs again for this rule alone.

DataFrame functions only. Offsets count code points. They come from the matches and the pieces between them, which
together make up the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path

_KEYWORD = "(password|passwd|secret|token|api_?key)"


@dataclass(frozen=True)
class Rule:
    """Matches of the pattern, leftmost and non-overlapping, whose group has min_chars characters."""

    kind: str
    version: str
    pattern: str
    group: int
    min_chars: int

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


RULES = (
    Rule("assign", "1", rf"""((?i){_KEYWORD}["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 3, 6),
    Rule("access", "1", r"(AKIA[A-Z0-9]+)", 1, 20),
    Rule("hex", "1", r"([0-9a-f]{24,})", 1, 24),
)
_SPANS = "array<struct<start:bigint,end:bigint>>"
_ROW = f"blob string, rule string, spans {_SPANS}"


def spans_of(text: Column, rule: Rule) -> Column:
    """Start and end of the rule's matches in a text."""
    pattern = F.lit(rule.pattern)
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), F.length)
    value = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length)
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    steps = F.arrays_zip(whole.alias("whole"), value.alias("value"), F.slice(between, F.lit(1), F.size(whole)).alias("gap"))
    nothing = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPANS).alias("found"))
    walked = F.aggregate(
        steps, nothing,
        lambda a, s: F.struct(
            (a["at"] + s["gap"] + s["whole"]).alias("at"),
            F.when(
                s["value"] >= rule.min_chars,
                F.concat(a["found"], F.array(F.struct((a["at"] + s["gap"]).alias("start"), (a["at"] + s["gap"] + s["whole"]).alias("end")))),
            ).otherwise(a["found"]).alias("found"),
        ),
    )
    return F.when(text.rlike(rule.pattern), walked["found"]).otherwise(F.array().cast(_SPANS))


def blob_of(text: Column) -> Column:
    """Content address. A null text is the empty blob."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


class Ledger:
    """A table of scanned (blob, rule version) pairs in a shared folder."""

    def __init__(self, spark, path: str | None = None):
        self.spark, self.path = spark, path or fresh_path(spark, "ledger")
        self.empty = path is None

    def rows(self) -> DataFrame:
        """Every pair once, even if a repeated write left it twice."""
        if self.empty:
            return self.spark.createDataFrame([], _ROW)
        return self.spark.read.schema(_ROW).parquet(self.path).dropDuplicates(["blob", "rule"])

    def update(self, versions: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
        """Scan the pairs of blobs and rules that are not in the ledger yet."""
        blobs = versions.select(blob_of(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        if self.empty:
            unseen = blobs.withColumn("seen", F.array().cast("array<string>"))
        else:
            seen = self.rows().select("blob", "rule").groupBy("blob").agg(F.collect_set("rule").alias("seen"))
            unseen = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
            unseen = unseen.where(F.size(F.array_except(F.array(*[F.lit(r.name) for r in rules]), "seen")) > 0)
        one = unseen.dropDuplicates(["blob"])
        scans = F.array(*[
            F.when(~F.array_contains("seen", r.name), F.struct(F.lit(r.name).alias("rule"), spans_of(F.col("text"), r).alias("spans"))) for r in rules
        ])
        scanned = one.select("blob", F.explode(F.array_compact(scans)).alias("s")).select("blob", "s.rule", "s.spans")
        scanned.write.mode("append").parquet(self.path)
        self.empty = False

    def findings(self, versions: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """The rows of versions with `blob` and, for each rule, its spans in a column of the rule's kind.

        Columns of versions with such a name are replaced; a null or empty text has no spans. Blobs that the ledger lacks have null.
        """
        found = self.rows().where(F.col("rule").isin([r.name for r in rules]))
        per_blob = found.groupBy("blob").agg(*[F.max(F.when(F.col("rule") == r.name, F.col("spans"))).alias(r.kind) for r in rules])
        rows = versions.drop("blob", *[r.kind for r in rules]).withColumn("blob", blob_of(F.col(text_col)))
        return rows.join(per_blob, "blob", "left")


def span_list(rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of all spans by start, then kind as listed, comma-joined."""

    def named(i: int, kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("i"), F.concat_ws(":", F.lit(kind), s["start"], s["end"]).alias("name")))

    every = F.concat(*[named(i, r.kind) for i, r in enumerate(rules)])
    return F.array_join(F.transform(F.array_sort(every), lambda s: s["name"]), ",")
