"""Toxic documents of a small language, with labels that no fit has seen."""

import random

from clausemesh.llm import quality


def test_toxic_words_of_a_small_language_are_chosen(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(1200):
        lang = "es" if i % 7 == 0 else "en"
        toxic, poor = rng.random() < 0.25, rng.random() < 0.4
        text = [f"{lang}{rng.randrange(300)}" for _ in range(60)]
        if poor:  # many words that tell poor documents, more than are kept
            text += [f"junk{rng.randrange(700)}" for _ in range(200)]
        if toxic:
            text[rng.randrange(60)] = f"vile{lang}"
        docs.append((i, " ".join(text), lang, "s"))
        labels.append((i, int(not poor), int(toxic)))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    seen = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, quality int, toxic int")
    keep = {r.k_id: r.keep for r in quality.classify(df, seen).collect()}
    for lang in ("en", "es"):
        toxic = [i for i, _, t in labels if t and i % 3 == 0 and docs[i][2] == lang]
        assert len(toxic) >= 5 and sum(not keep[i] for i in toxic) >= 0.9 * len(toxic)
    good = [i for i, q, t in labels if q and not t and i % 3 == 0]
    assert sum(keep[i] for i in good) >= 0.9 * len(good)
