"""The pipeline's near dedup against all pairs compared one by one."""

import random

import corpus_pipeline
from clausemesh.llm import near_copies


def sets_of(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_every_pair_of_similarity_is_linked(spark, sf):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    shared = [rng.choice(words) for _ in range(60)]
    texts = []
    for _ in range(40):  # each base with edits that leave a similarity from about 0.5 to 1
        base = [rng.choice(words) for _ in range(rng.randint(4, 200))] + shared * rng.randint(0, 1)
        for edits in (0, 1, 2, 3, 4, 5, 6):
            own = list(base)
            for _ in range(edits * len(base) // 120 + (edits == 1)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = [sets_of(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = 0
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both * 5 >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
                linked += sets[i] != sets[j]
    assert linked > 50
    groups = {}
    for r in near_copies.similar_groups(df).collect():
        groups.setdefault(r.root, set()).add(r.k_id)
    want = {}
    for i in range(len(texts)):
        want.setdefault(find(i), set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    kept = {r.doc_id for r in corpus_pipeline.one_of_near_copies(spark, df, sf).collect()}
    assert kept == set(want)


def test_links_begin_with_the_trie_of_fingerprints(spark, monkeypatch):
    """The trie brings near fingerprints together, each link is verified, and the prefix join adds what it misses."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(400)]
    texts = [" ".join(base), " ".join([*base[:399], "x"]), " ".join([*base[:398], "y", "x"]), " ".join(base[100:])]
    texts += [" ".join(f"v{rng.randrange(900)}" for _ in range(80)) for _ in range(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []
    make = near_copies._alike
    monkeypatch.setattr(near_copies, "_alike", lambda pairs, *a: seen.append(pairs.count()) or make(pairs, *a))
    walked = []
    walk = near_copies.simhash.links
    monkeypatch.setattr(near_copies.simhash, "links", lambda fps, budget: walked.append(budget) or walk(fps, budget))
    groups = {}
    for r in near_copies.similar_groups(df).collect():
        groups.setdefault(r.root, set()).add(r.k_id)
    assert walked == [near_copies.simhash.BUDGET] and seen[0] >= 1
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2], [3], [4], [5], [6]]


def test_two_thousand_near_copies_in_proportion(spark):
    """One group of near copies is joined without its pairs, and hashes of several components are dealt in parts."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    base, other = ([rng.choice(words) for _ in range(150)] for _ in range(2))
    for n in (2000,):
        texts = []
        for i in range(n):
            own = list(base)
            own[rng.randrange(len(own))] = f"x{i}"
            texts.append(" ".join(own))
        for i in range(40):  # another group that shares a passage with the first
            own = list(other) + base[:60]
            own[rng.randrange(len(own))] = f"y{i}"
            texts.append(" ".join(own))
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        groups = {}
        for r in near_copies.similar_groups(df, group_rows=100).collect():
            groups.setdefault(r.root, set()).add(r.k_id)
        assert sorted(map(len, groups.values())) == [40, n]


def test_neighbour_rows_grow_in_proportion():
    """The rows that a group of one hash gives, and the pairs across components of it."""
    import numpy as np
    import pyarrow as pa

    def rows(n):
        cols = [np.full(n, 7), (np.full(n, 100) << 32) + 3, np.arange(n), np.zeros(n, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols[:3]], names=["h", "nat", "s"])

    for n in (10, 1000, 20_000):
        found = pa.Table.from_batches(list(near_copies._neighbours(0.8)(iter([rows(n)]))))
        assert found.num_rows == n and found["p"].null_count == 1
        one_root = [np.full(n, 1), np.full(n, 5), np.full(n, 100), np.full(n, 3), np.arange(n), np.zeros(n, np.int64)]
        batch = pa.RecordBatch.from_arrays([*map(pa.array, one_root), pa.array(np.ones(n, bool)), pa.array(np.full(n, 20))], names=list("grnasp") + ["whole", "c"])
        assert list(near_copies._across(0.8)(iter([batch]))) == []
        one_root[1] = np.append(np.full(n - 1, 5), 6)  # one set of another component
        batch = pa.RecordBatch.from_arrays([*map(pa.array, one_root), pa.array(np.ones(n, bool)), pa.array(np.full(n, 20))], names=list("grnasp") + ["whole", "c"])
        assert sum(b.num_rows for b in near_copies._across(0.8)(iter([batch]))) == n - 1
        one_root[1] = np.arange(n)  # all apart, but none shares enough hashes to be like any other
        batch = pa.RecordBatch.from_arrays([*map(pa.array, one_root), pa.array(np.ones(n, bool)), pa.array(np.full(n, 8))], names=list("grnasp") + ["whole", "c"])
        assert list(near_copies._across(0.8)(iter([batch]))) == []


def test_sketches_rule_out_no_similar_pair():
    """A sketch never says less than two sets share, whatever their sizes, and tells most unlike sets apart."""
    import numpy as np

    rng = np.random.default_rng(4)
    told = 0
    for n in (1, 3, 17, 200, 3000):
        for share in (0.0, 0.3, 0.79, 0.9, 1.0):
            for more in (0, n // 5, 8 * n):
                x = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
                both = int(share * len(x))
                y = np.unique(np.append(x[:both], rng.integers(-(2**63), 2**63 - 1, len(x) - both + more)))
                a, b = (np.frombuffer(near_copies._sketch(s), np.uint8) for s in (x, y))
                most, own = near_copies._most_shared(len(x), a, len(y), b), len(np.intersect1d(x, y))
                assert own <= most <= min(len(x), len(y))
                assert most == near_copies._most_shared(len(y), b, len(x), a)
                told += most < 0.8 / 1.8 * (len(x) + len(y))
    assert told >= 40


def test_only_texts_of_likely_pairs_are_moved(spark, monkeypatch):
    """Texts that share a passage, but are not alike, are told apart by their sketches."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(4000)]
    passage = [rng.choice(words) for _ in range(120)]
    rows = [" ".join(passage + [rng.choice(words) for _ in range(80)]) for _ in range(30)]
    texts = spark.createDataFrame(list(enumerate([*rows, rows[0] + " end"])), "s long, text string").repartition(3)
    pairs = spark.createDataFrame([(a, b) for b in range(31) for a in range(b)], "a long, b long")
    moved = []
    keep = near_copies.stored
    monkeypatch.setattr(near_copies, "stored", lambda df, name: moved.append((name, found := keep(df, name))) or found)
    sketches = near_copies._drawn(texts, 5).select("s", "n", "sketch")
    assert [tuple(r) for r in near_copies._alike(pairs, sketches, texts, 0.8, 5).collect()] == [(0, 30)]
    assert [df.count() for name, df in moved if name == "near-texts"] == [2]


def test_tables_for_the_driver_come_as_arrow(spark, monkeypatch):
    """toPandas() makes Python objects of all rows in the driver, ten times what they take as Arrow columns."""
    from pyspark.sql.classic.dataframe import DataFrame

    def refuse(self):
        raise AssertionError("toPandas")

    monkeypatch.setattr(DataFrame, "toPandas", refuse)
    df = spark.createDataFrame([(i, "a b c d e f g h") for i in range(3)], "doc_id long, text string")
    assert [r.doc_id for r in near_copies.keep_one(df).collect()] == [0]
