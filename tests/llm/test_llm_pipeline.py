"""The pipeline on a small corpus of which every outcome is known, stage by stage."""

import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in ("ba", "de", "ki", "lo") for b in ("ra", "mu", "ti", "so") for c in ("n", "s", "l", "")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs, labels, kind = [], [], {}

    def add(t, k):
        docs.append((len(docs), t, "en", f"s{len(docs) % 4}", len(t)))
        kind[len(docs) - 1] = k

    shape = lambda: [text(rng.randint(60, 150)) for _ in range(rng.randint(1, 4))]
    for i in range(300):
        add("\n".join(shape()), "clean")
    for i in range(80):
        lines = shape()
        lines[0] += " vileword nastyword"
        add("\n".join(lines), "toxic")
    labels = [(i, 1, int(k == "toxic")) for i, k in kind.items() if i % 5]
    passage = text(60)
    for i in range(6):
        add(text(80) + "\n" + passage + "\n" + text(80), "passage")
    item = text(30)
    for i in range(5):
        add(text(50) + " " + item + " " + text(50), "leak")
    base = text(400)
    for i in range(6):
        own = base.split()
        own[rng.randrange(len(own))] = "changed"
        add(" ".join(own), "near")
    exact = text(120)
    for i in range(4):
        add(exact, "copy")
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, text(20))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, {x[0]: x[1] for x in docs}, kind, passage


def test_pipeline(spark, corpus):
    d, texts, kind, passage = corpus
    of = lambda k: [i for i in kind if kind[i] == k]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d).cache()
        kept[name] = {r.doc_id: r for r in docs.collect()}
    good = kept["quality classifier"]
    assert not set(of("toxic")) & set(good) and len(set(kind) - set(of("toxic")) - set(good)) <= 3
    lines = kept["line dedup"]
    passages = [i for i in of("passage") if i in lines]
    assert [passage in lines[i].text for i in passages] == [True] + [False] * (len(passages) - 1)
    assert all(lines[i].text == texts[i] and lines[i].n_chars == len(texts[i]) for i in of("clean") if i in lines)
    assert all(lines[i].n_chars == len(lines[i].text) for i in passages)
    near = kept["near dedup"]
    assert len([i for i in of("near") if i in near]) == 1 and len([i for i in of("copy") if i in near]) == 1
    assert all(i in near for i in of("clean") if i in lines)
    clean = kept["benchmark decontamination"]
    assert not set(of("leak")) & set(clean) and all(i in clean for i in of("clean") if i in near)
    coded = kept["sentencepiece encoding"]
    assert set(coded) == set(clean) and all(r.round_trip and r.parity for r in coded.values())
    whole = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, d).collect()}
    assert whole == {i: r.n_tokens for i, r in coded.items()}
