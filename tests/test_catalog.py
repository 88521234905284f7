"""Registered queries against their SQL on the smallest tables. CLAUSEMESH_QUICK=1 runs only some."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from clausemesh.catalog import ORACLES

SOME = [
    "interval_solve", "solve_status", "solve_trace", "soft_fallback", "constraint_dedup", "spec_constraints", "brand_solve", "unit_normalize",
    "chunk_packs", "chunk_loss_free", "cosine_topk", "sparse_dot", "bm25_topk", "rrf_duplicates", "hybrid_retrieve", "retry_scan", "replay_gate",
    "triage_failures", "audit_required", "replay_match", "latency_nearest", "label_pick", "recall_eval", "source_blocks", "ingest_outcomes", "quota_flags",
]
NAMES = sorted(ORACLES) if not os.environ.get("CLAUSEMESH_QUICK") else SOME
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, con, name):
    df = E.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    con.execute(E.oracle_sql()[name])
    names = [c[0] for c in con.description]
    order = [names.index(c) for c in cols]
    want = sorted(tuple(norm(r[i]) for i in order) for r in con.fetchall())
    assert sorted(names) == cols and got == want


def test_entry_runs(spark):
    assert E.entry(spark).count() > 0
