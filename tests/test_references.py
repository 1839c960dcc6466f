from paperloom.operators import references as R

SPEC = [R.Reference("refs", "target", "id", "at", "things")]
PARENTS = {"things": R.Parent("key", "start", "end")}
REFS = "id bigint, target string, at timestamp_ntz, key string, parent string"
THINGS = "key string, start timestamp_ntz, end timestamp_ntz, at string"


def run(spark, refs, things, **k):
    tables = {"refs": spark.createDataFrame(refs, REFS), "things": spark.createDataFrame(things, THINGS)}
    return R.reference_status(tables, SPEC, PARENTS, **k)


def states(df):
    return {r.record_id: r.status for r in df.collect()}


def test_states_keys_and_clashing_columns(spark, day):
    things = [("A", day(5), None, "x"), ("b", day(2), day(10), "x"), ("b", day(12), None, "x"), ("c", day(20), None, None), ("d", None, None, None), (None, day(1), None, None)]
    refs = [
        (1, " a\n", day(5), None, None), (2, "A", day(4), None, None), (3, "B", day(9), None, None), (4, "b", day(10), None, None), (5, "b", day(12), None, None),
        (6, "C\t", day(1), None, None), (7, "zz", day(1), None, None), (8, None, day(1), None, None), (9, "  ", day(1), None, None), (10, "", day(1), None, None), (11, "d", day(3), None, None), (12, "a", None, None, None),
    ]
    got = states(run(spark, refs, things))
    assert got == {1: "present", 2: "late", 3: "present", 4: "deleted", 5: "present", 6: "late", 7: "missing", 11: "missing", 12: "undated"}


def test_repeated_rows_come_out_once(spark, day):
    df = run(spark, [(1, "x", day(1), None, None)] * 3, [("y", day(1), None, None)] * 2)
    assert R.orphans(df).count() == 1
    report = R.orphan_report(df).collect()
    assert [(r.references, r.missing) for r in report] == [(1, 1)]


def test_empty_tables(spark):
    assert R.orphans(run(spark, [], [])).count() == 0
    assert R.orphan_report(run(spark, [], [])).count() == 0


def test_hot_keys_are_salted_with_the_same_result(spark, day):
    things = [("hot", day(5), day(20), None), ("hot", day(25), None, None), ("cold", day(1), None, None)]
    refs = [(i, "hot" if i % 3 else "cold", day(1 + i % 28), None, None) for i in range(600)]
    plain = states(run(spark, refs, things))
    assert states(run(spark, refs, things, hot_at_least=50)) == plain
    assert set(plain.values()) == {"present", "deleted", "late"}
