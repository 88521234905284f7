"""The subpackage's queries that SQL can express against their SQL, and brute force for the others, on whole tables."""

import hashlib
import math
import re

import duckdb
import numpy as np
import pytest
import xxhash

from clausemesh.llm.queries import ORACLES, QUERIES

TABLES = "documents pages benchmark labels embeddings".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(cursor_rows):
    return sorted(tuple(repr(v) for v in r) for r in cursor_rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = rows(df.select(*cols).collect())
    con.execute(ORACLES[name])
    names = [c[0] for c in con.description]
    assert sorted(names) == cols
    assert got == rows(tuple(r[names.index(c)] for c in cols) for r in con.fetchall())


def documents(con):
    return con.execute("SELECT doc_id, text, lang FROM documents ORDER BY doc_id").fetchall()


def simhash(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(prints, budget=4):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= budget:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_query(spark, sf, con):
    prints = {i: simhash(t) for i, t, _ in documents(con)}
    want = near_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash_trie"](spark, sf).collect()}
    assert got == {i: (f"{f:016x}", want[i]) for i, f in prints.items()}


def test_merkle_query(spark, sf, con):
    docs = documents(con)
    got = {r.doc_id: r for r in QUERIES["op6_merkle_fingerprints"](spark, sf).collect()}
    assert len(got) == len(docs)
    for k, (i, text, _) in enumerate(docs):
        following, half = docs[(k + 1) % len(docs)][1], len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1
        assert (got[i].near_edited == 1) == (changed == text)
    assert np.mean([r.near_edited for r in got.values()]) > 0.4 > 0.1 > np.mean([r.near_next for r in got.values()])


def test_codec_query(spark, sf, con):
    import sentencepiece

    from clausemesh.llm.sentencepiece_codec import MODEL

    original = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: r for r in QUERIES["op7_sentencepiece_codec"](spark, sf).collect()}
    for i, text, _ in documents(con):
        assert got[i].token_ids == original.encode(text) and got[i].n_tokens == len(got[i].token_ids)
        assert got[i].round_trip and got[i].parity


def test_language_query_on_held_out_documents(spark, sf, con):
    lang = {i: x for i, _, x in documents(con)}
    got = QUERIES["op8_byte_network_language"](spark, sf).collect()
    assert len(got) == len(lang)
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


def test_quality_query(spark, sf, con):
    got = {r.doc_id: r for r in QUERIES["op1_cotrained_quality"](spark, sf).collect()}
    labelled = con.execute("SELECT l.doc_id, quality, toxic FROM labels l JOIN documents USING (doc_id)").fetchall()
    right = [got[i].keep == (q == 1 and t == 0) for i, q, t in labelled]
    assert len(got) == 200 and np.mean(right) > 0.85
    assert all(0 <= r.score <= 1 and not math.isnan(r.score) for r in got.values())


def test_neighbours_recall(spark, sf, con):
    """At least nine in ten of the true neighbours, in order, each with its exact inner product."""
    rows = con.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    x = np.array([v for _, v in rows], float)
    got = {}
    for r in QUERIES["op12_multi_index_neighbours"](spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i, _ in rows if i % 20 == 0}
    at = {i: k for k, (i, _) in enumerate(rows)}
    right = []
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in {i for _, i, _ in found}
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        assert all(abs(s - x[at[q]] @ x[at[i]]) < 1e-12 for _, i, s in found)
        scores = x @ x[at[q]]
        scores[at[q]] = -np.inf
        true = {rows[k][0] for k in np.argsort(-scores, kind="stable")[:20]}
        right.append(len(true & {i for _, i, _ in found}) / 20)
    assert np.mean(right) >= 0.9


def test_both_views_hand_over_documents(spark):
    """At two sizes each view gives documents in every round, and held-out labels are told as well as without it."""
    from clausemesh.llm import quality

    for sf, least in (("/root/testdata/sf0.01", 20), ("/root/testdata/sf0.1", 200)):
        docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
        figures, n_words = quality.figures_of(docs, labels.where("doc_id % 3 <> 0"), "doc_id", "text", "source", "lang", quality.MAX_LABELLED)
        truth = labels.where("doc_id % 3 = 0").selectExpr("doc_id AS k_id", "int(quality = 1 AND toxic = 0) AS y")
        unseen = figures.drop("good", "clean").join(truth, "k_id").toPandas()
        model = quality.co_train(figures, n_words)
        assert all(sum(view) >= least for given in model.given for view in given)
        right = lambda m: ((m.scores(unseen)[1] >= 0.5) == unseen["y"]).mean()
        assert right(model) >= max(0.9, right(quality.co_train(figures, n_words, rounds=0)) - 0.02)
