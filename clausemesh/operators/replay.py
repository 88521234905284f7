"""Running a query again: digests of whole result sets, and what a second run says of the first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _canonical(column: Column, kind: T.DataType, digits: int) -> Column:
    """Numbers with a fraction at so many digits and without negative zero; everything else as it is."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.round(column.cast("double"), digits) + F.lit(0.0)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _canonical(x, kind.elementType, digits))
    if isinstance(kind, T.StructType):
        fields = [_canonical(column[f.name], f.dataType, digits).alias(f.name) for f in kind.fields]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.MapType):
        return F.array_sort(F.map_entries(column))
    return column


def result_digest(rows: DataFrame, digits: int = 9) -> DataFrame:
    """n_rows and digest of a whole result set, one row. The order of rows and of columns has no effect, repeated rows
    count as often as they occur. Each row has a hash of its columns by name; sums of four parts of all hashes are taken,
    which tasks combine before the shuffle."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    row = F.to_json(F.struct(*[_canonical(F.col(f"`{c}`"), kinds[c], digits).alias(c) for c in sorted(kinds)]), {"ignoreNullFields": "false"})
    parts = [F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = [F.coalesce(F.sum(p), F.lit(0)).cast("string").alias(f"s{i}") for i, p in enumerate(parts)]
    whole = rows.select(F.sha2(row, 256).alias("h")).agg(F.count(F.lit(1)).alias("n_rows"), *sums)
    schema = F.lit(",".join(f"{c}:{kinds[c].simpleString()}" for c in sorted(kinds)))
    return whole.select("n_rows", F.sha2(F.concat_ws("|", schema, F.col("n_rows").cast("string"), "s0", "s1", "s2", "s3"), 256).alias("digest"))


def record(run: Callable[[], DataFrame], inputs: dict[str, DataFrame], version: str) -> dict[str, str]:
    """What a later replay needs: the version of the plan, the digest of each input and of the result, and its rows."""
    result = result_digest(run()).first()
    inputs_of = {f"input:{name}": result_digest(df).first()["digest"] for name, df in inputs.items()}
    return {"version": version, "result": result["digest"], "n_rows": str(result["n_rows"]), **inputs_of}


def replay(recorded: dict[str, str], run: Callable[[], DataFrame], inputs: dict[str, DataFrame], version: str) -> str:
    """full_match, mismatch, or why the runs cannot be compared: version_changed or input_changed. The query runs again
    only if its plan and all inputs are those of the record."""
    if recorded["version"] != version:
        return "version_changed"
    names = {f"input:{name}" for name in inputs}
    if names != {k for k in recorded if k.startswith("input:")} or any(result_digest(df).first()["digest"] != recorded[f"input:{n}"] for n, df in inputs.items()):
        return "input_changed"
    return "full_match" if result_digest(run()).first()["digest"] == recorded["result"] else "mismatch"
