from pyspark.sql import functions as F

from clausemesh.operators import constraints as C
from clausemesh.operators import hints as H
from clausemesh.operators import solving as SO
from clausemesh.plans import answer as A

# text, scope -> parameter, lower, upper, unit of the solved range (None: nothing solved)
CASES = [
    ("温度不得超过80°C", None, ("temperature", None, 80.0, "°C")),
    ("压力不低于1.0MPa", None, ("pressure", 1e6, None, "pa")),
    ("不得超过100 MPa", None, ("pressure", None, 1e8, "pa")),
    ("压力为1.5 MPa", None, None),
    ("温度应在50℃至80℃之间", None, None),
    ("温度不得超过300K", None, ("temperature", None, 26.85, "°C")),
    ("温度不得超过176°F", None, ("temperature", None, 80.0, "°C")),
    ("本文件描述了流程", None, None),
    ("温度不得超过50°C，且温度不低于80°C", None, ("temperature", None, 50.0, "°C")),
    ("厚度不超过10mm", None, ("length", None, 0.01, "m")),
    ("钢筋延伸率不低于20%", ["industry"], ("percentage", 20.0, None, "%")),
    ("至少60 MPa", None, None),
    ("pressure from 2 bar to 5 bar", None, ("pressure", 2e5, 5e5, "pa")),
    ("width is 5 cm", None, None),
    ("测量温度为80°C", None, None),
]


def v2(spark, rows):
    schema = (
        "q int, ord long, branch string, parameter string, interval struct<lower:double,upper:double,lower_inclusive:boolean,"
        "upper_inclusive:boolean>, unit string, level int, confidence double, scope_path array<string>"
    )
    return spark.createDataFrame(rows, schema)


def test_texts_to_ranges(spark):
    rows = [(i, t, s, f"d{i}") for i, (t, s, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "q int, text string, scope_path array<string>, doc_hash string")
    built = C.build_constraints(df, ["q"]).withColumn("ord", F.col("hint_ord").cast("long"))
    best = C.dedup_constraints(built, ["q"], [F.col("ord")])
    got = {r.q: r for r in SO.solve_ranges(best, ["q"]).where("solved").collect()}
    for i, (text, _, want) in enumerate(CASES):
        if want is None:
            assert i not in got, text
            continue
        r = got[i]
        assert (r.parameter, r.unit) == (want[0], want[3]), text
        for have, expect in ((r.range_lower, want[1]), (r.range_upper, want[2])):
            assert (have is None) == (expect is None) and (expect is None or abs(have - expect) < 0.01), text


def test_compat_reads_a_unit_letter_inside_a_word(spark):
    df = spark.createDataFrame([(1, "5cm")], "q int, text string")
    assert [r.unit for r in H.extract_hints(df).collect()] == ["cm"]
    assert [r.unit for r in H.extract_hints(df, compat=True).collect()] == ["c"]


def test_conflict_and_trace(spark):
    rows = [
        (1, 0, "general", "t", (None, 50.0, True, True), "°C", 40, 1.0, None),
        (1, 1, "general", "t", (80.0, None, True, True), "°C", 40, 1.0, None),
        (2, 0, "general", "t", (None, 100.0, True, True), "°C", 20, 0.9, None),
        (2, 1, "general", "t", (None, 60.0, True, False), "°C", 100, 0.8, None),
        (3, 0, "general", "t", None, "°C", 40, 1.0, None),
    ]
    df = v2(spark, rows)
    got = {r.q: r for r in SO.solve_ranges(df, ["q"]).collect()}
    assert got[1].had_conflict and got[1].interval_text == "()"
    assert got[2].solved and got[2].range_upper is None and got[2].upper == 60.0 and got[2].interval_text == "(-inf,60.0)"
    assert not got[3].solved and not got[3].had_conflict
    status = {r.q: r.status for r in SO.solve_status(SO.solve_ranges(df, ["q"]), ["q"]).collect()}
    assert status == {1: "CONFLICT", 2: "OK", 3: "EMPTY"}
    trace = SO.solve_trace(df, ["q"]).orderBy("q", "step").collect()
    assert [(r.q, r.action, r.interval_snapshot) for r in trace] == [
        (1, "applied", "(-inf,+inf)"), (1, "conflict", "(-inf,50.0]"), (2, "applied", "(-inf,+inf)"), (2, "applied", "(-inf,60.0)")
    ]
    assert trace[1].reason == (
        "intersection with interval {'lower': 80.0, 'upper': None, 'lower_inclusive': True, 'upper_inclusive': True} is empty"
    )


def test_hot_group_trace_equals_plain(spark):
    rows = [
        (i % 2 if i % 3 else 0, i, "general", "t", (float(i % 7), float(100 - i % 11), i % 2 == 0, True), "m", [20, 40, 60][i % 3], 1.0 - (i % 5) / 10, None)
        for i in range(400)
    ]
    df = v2(spark, rows).repartition(5)
    plain = SO.solve_trace(df, ["q"]).orderBy("q", "step").collect()
    hot = SO.solve_trace(df, ["q"], hot_rows=50).orderBy("q", "step").collect()
    assert plain == hot and len(hot) == 400


def test_scope_decides_who_takes_part(spark):
    rows = [
        (1, 0, "general", "t", (None, 80.0, True, True), "m", 100, 1.0, ["national", "GB"]),
        (1, 1, "general", "t", (200.0, None, True, True), "m", 60, 1.0, ["enterprise", "Acme"]),
    ]
    active = lambda *p: F.array(*[F.lit(x) for x in p])
    one = SO.solve_ranges(v2(spark, rows).withColumn("active_scope", active("national", "GB")), ["q"]).first()
    assert one.solved and one.range_upper == 80.0
    none = SO.solve_ranges(v2(spark, rows).withColumn("active_scope", active("project", "secret")), ["q"]).first()
    assert not none.solved and not none.had_conflict
    skipped = SO.solve_trace(v2(spark, rows).withColumn("active_scope", active("national", "GB")), ["q"]).where("action = 'skipped_scope'").first()
    assert skipped.reason == "scope ['enterprise', 'Acme'] != ['national', 'GB']"


def test_fallback_paths(spark):
    cols = (
        "request_id int, ord long, parameter string, operator string, lower double, upper double, unit string, level int, confidence double,"
        "scope_path array<string>, strict boolean, allow_soft_fallback boolean"
    )
    def req(i, strict, allow, soft_level):
        return [
            (i, 0, "temp", "<=", 50.0, None, "°F", 100, 0.9, None, strict, allow),
            (i, 1, "temp", ">=", 80.0, None, "°C", soft_level, 0.5, None, strict, allow),
        ]
    df = spark.createDataFrame(req(1, True, True, 20) + req(2, False, True, 20) + req(3, False, True, 40) + req(4, False, False, 20), cols)
    got = {r.request_id: r for r in A.calculate(df, ["request_id"]).collect()}
    assert got[1].path == "strict_violation"
    assert got[2].path == "soft" and got[2].had_conflict and got[2].interval_text == "[80.0,+inf)" and got[2].confidence == 0.5
    assert got[3].path == "all" and got[3].interval_text == "()" and got[3].parameter == "temperature" and got[3].confidence == 0.9
    assert got[4].path == "all"


def test_gates_and_answer(spark):
    hits = spark.createDataFrame(
        [(1, 1, "c1", "温度不得超过80°C", ["national"], "d"), (2, 1, "c2", "nothing", ["national"], "d")],
        "query_id int, final_rank int, chunk_id string, text string, scope_path array<string>, doc_hash string",
    )
    qs = spark.createDataFrame([(1, False, None), (2, False, None), (3, True, ["x"])], "query_id int, strict boolean, active_scope array<string>")
    verdict, ranges, trace = A.answer(qs, hits)
    got = {r.query_id: (r.gate, r.code, r.mode) for r in verdict.collect()}
    assert got == {1: ("success", 200, "single"), 2: ("no_constraints_extracted", 404, "single"), 3: ("insufficient_recall", 404, "multi_branch")}
    assert ranges.first().range_upper == 80.0 and trace.count() == 1
