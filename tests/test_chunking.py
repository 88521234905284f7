import random

from pyspark.sql import functions as F

from clausemesh.functions import text as X
from clausemesh.operators import chunking as CH

META = "struct<heading_path:array<string>,page_number:int,form_fields:array<map<string,string>>,column_headers:array<struct<index:int,header:string>>>"
SCHEMA = (
    "doc_hash string, version int, doc_type string, block_ord long, block_id string, type string, metadata " + META
    + ", content struct<raw:string,md_preview:string,structured:array<array<string>>>"
)


def block(doc, i, text, kind="text", scope=("a",), page=1, fields=None, headers=None, structured=None):
    return (doc, 1, "unknown", i, f"b{i}", kind, (list(scope), page, fields, headers), (text, "", structured))


def run(spark, rows, budget=768):
    out = CH.chunk_blocks(spark.createDataFrame(rows, SCHEMA), budget)
    return out.orderBy("doc_hash", "chunk_index").collect()


def test_scope_change_table_and_budget(spark):
    rows = [
        block("d", 0, "Alpha.", fields=[{"k": "v"}]), block("d", 1, "Beta.", page=2), block("d", 2, "Gamma.", scope=("b",)),
        block("d", 3, "x | y", "table", scope=("b",)), block("d", 4, "", scope=("b",)), block("d", 5, "Delta.", scope=("b",)),
    ]
    got = run(spark, rows)
    assert [r.text for r in got] == ["Alpha.\nBeta.", "Gamma.", "x | y", "Delta."]
    assert got[0].source_block_ids == ["b0", "b1"] and got[0].page_numbers == [1, 2] and got[0].form_fields == [{"k": "v"}]
    assert [r.chunk_id for r in got] == ["d-0000", "d-0001", "d-0002", "d-0003"]


def test_unsafe_pair_is_split_by_line(spark):
    rows = [block("d", 0, "pres"), block("d", 1, "sure"), block("d", 2, "next", scope=("b",))]
    assert [r.text for r in run(spark, rows)] == ["pres", "sure", "next"]


def test_long_block_keeps_number_and_unit(spark):
    text = " ".join(["word"] * 30) + " 350MPa " + "tail " * 40
    got = run(spark, [block("d", 0, text)], 40)
    assert "".join(r.text for r in got) == text
    assert all(r.token_count <= 41 for r in got) and any("350MPa" in r.text for r in got)


def test_table_rows(spark):
    short = [["h1", "h2"]] + [[f"r{i}", "v" * 20] for i in range(400)]
    raw = "\n".join(" ".join(r) for r in short)
    got = run(spark, [block("d", 0, raw, "table", structured=short)], 100)
    assert 20 < len(got) < 40 and all(r.token_count <= 100 for r in got)
    assert all(r.text.startswith("h1 | h2\n") for r in got) and not any(r.quality_warning for r in got)
    big = [["h"], ["ok"], ["z " * 400], ["ok"]]
    got = run(spark, [block("d", 0, " ".join(r[0] for r in big), "table", structured=big)], 50)
    warned = [r for r in got if r.quality_warning]
    assert warned and all(r.token_count <= 50 for r in got)
    assert "".join(r.text for r in warned) == "z " * 400
    assert [r.text for r in got if not r.quality_warning] == ["h\n\nok", "h\n\nok"]


def _random_blocks(seed, n):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rnd.choice(["text"] * 12 + ["table", "kv"])
        words = " ".join(rnd.choice(["pump", "12", "MPa.", "温度", "x-1", "valve,"]) for _ in range(rnd.choice([1, 3, 8, 20, 90])))
        rows.append(block(f"d{seed}", i, words, kind, scope=("s", str(i // rnd.choice([7, 50]))), page=i // 9 + 1))
    return rows


def test_documents_over_many_units_equal_one_unit(spark, monkeypatch):
    """The carried states of small units give exactly what one unit gives."""
    rows = [r for s in range(6) for r in _random_blocks(s, 90)]
    key = lambda rs: [(r.doc_hash, r.chunk_index, r.text, r.source_block_ids, r.page_numbers) for r in rs]
    whole = key(run(spark, rows, 30))
    monkeypatch.setattr(CH, "UNIT_BLOCKS", 5)
    monkeypatch.setattr(CH, "FAN", 3)
    assert key(run(spark, rows, 30)) == whole and len(whole) > 300


def test_partitions_do_not_matter(spark):
    rows = _random_blocks(9, 120)
    df = spark.createDataFrame(rows, SCHEMA)
    a = CH.chunk_blocks(df.repartition(2), 40).orderBy("chunk_index").collect()
    b = CH.chunk_blocks(df.repartition(8), 40).orderBy("chunk_index").collect()
    assert a == b


def test_texts_need_no_shuffle(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    c = CH.chunk_texts(docs, F.col("doc_id").cast("string"), F.lit(1), F.lit("u"), F.array("lang"), F.col("text"))
    plan = c._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_cut_line_is_loss_free_and_bounded():
    rnd = random.Random(3)
    for _ in range(200):
        text = "".join(rnd.choice("ab1. 2MPa温度，xyz") for _ in range(rnd.randrange(1, 300)))
        limit = rnd.randrange(5, 60)
        pieces = X.cut_line(text, limit)
        assert all(len(p) <= limit for p in pieces)
        rest = text
        for p in pieces:
            at = rest.index(p)
            assert not rest[:at].strip()
            rest = rest[at + len(p):]
        assert not rest.strip()
    assert X.cut_line("flow 350MPa", 8) == ["flow ", "350MPa"]


def test_atomic_headers_and_joins(spark):
    df = spark.createDataFrame([("abc 350", "MPa"), ("350", "℃"), ("3", ".5"), ("end.", "Next"), ("", "a")], "l string, r string")
    got = [tuple(r) for r in df.select(X.safe_join(F.col("l"), F.col("r")), X.is_atomic(F.col("l"))).collect()]
    assert got == [(False, False), (True, False), (False, False), (True, True), (True, False)]
