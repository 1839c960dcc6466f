import pytest

from paperloom.operators import units as U

ROWS = {"bath temperature": ("temperature", "°C"), "sample mass": ("mass", "mg"), "incubation time": ("time", "s"), "flow rate": ("volume flow", "mL/min"), "product yield": ("share", "%"), "substrate concentration": ("amount concentration", "µM"), "dose volume": ("volume", "mL")}
PATTERN = U.Metrics(ROWS).pattern()


def amount(value=None, unit=None, metric=None, text=None):
    r = U.read_one(ROWS, PATTERN, value, unit, metric, text)
    return r and r[7]


@pytest.mark.parametrize(
    ("args", "want"),
    [
        (("1,234", "g", "Sample_Mass", None), 1_234_000_000), (("1,5", "g", "sample-mass", None), 1_500_000), (("13 300", "mg", "SAMPLE  MASS", None), 13_300_000),
        (("5.15E+02", None, "incubation time (s)", None), 515_000), (("2.2×10²", None, "incubation time, min", None), 13_200_000), (("5 × 10^-2 h", None, "incubation time", None), 180_000),
        (("630.2 - 819.26", "s", "incubation time", None), 630_200), (("72.9 ± 3", "°F", "bath temperature", None), 22_722), (("ca. 300 K", None, "bath temperature", None), 26_850), (("−22", "degrees  Celsius", "bath temperature", None), -22_000),
        ((None, None, "flow rate", "Line 14 delivered 2 mL·min⁻¹ today."), 2_000), ((None, " ", "flow rate [ml s-1]", "The pump ran at 3 mL/s."), 180_000), (("0.5", None, "product yield in fraction", None), 50_000),
        (("3", None, "substrate concentration [mol m^-3]", None), 3_000_000), (("7fl oz", None, "dose volume", None), 207_015), (("2", "MG", "sample mass", None), None), (("2", "MILLIGRAMS", "sample mass", None), 2_000),
    ],
)
def test_reading(args, want):
    assert amount(*args) == want


@pytest.mark.parametrize("args", [("5", "kPa", "sample mass", None), ("high", "g", "sample mass", None), ("5", "n.d.", "sample mass (g)", "5 g"), (None, None, None, "5 g"), ("5", "g", "score", None), (None, "g", "sample mass", None), ("", "", "", "")])
def test_no_case(args):
    assert amount(*args) is None


PAYLOADS = "payload_id bigint, type string, value string, unit string, metric string, text string, dataset string, condition string, number string, amount string"


def units(spark):
    return spark.createDataFrame([(m, q, u) for m, (q, u) in ROWS.items()], "metric string, quantity string, common_unit string")


def test_operator_with_nulls_duplicates_and_clashing_columns(spark):
    rows = [(1, "result", "5", "g", "sample mass", None, None, None, "x", "y")] * 2 + [(2, None, "5", "g", "sample mass", None, None, None, None, None), (3, "Result ", None, None, None, None, None, None, None, None), (4, "claim", "5", "g", "sample mass", None, None, None, None, None), (5, "result", "5", None, "sample mass", None, None, None, None, None)]
    got = {r.payload_id: (r.status, r.amount) for r in U.convert_quantities(spark.createDataFrame(rows, PAYLOADS), units(spark)).collect()}
    assert got == {1: ("read", 5_000_000), 5: ("review", None)}


def test_empty_table(spark):
    assert U.convert_quantities(spark.createDataFrame([], PAYLOADS), units(spark)).count() == 0


def test_missing_units_are_predicted_where_magnitudes_tell(spark):
    rows = []
    for i in range(600):
        unit, value = ("kg", f"0.00{1 + i % 9}") if i % 2 else ("µg", str(500_000 + 1000 * (i % 50)))
        rows.append((i, "result", value, unit, "sample mass", None, f"d{i % 5}", None, None, None))
    hidden = [(1000 + i, "result", "0.004" if i % 2 else "512000", None, "sample mass", None, "d1", None, None, None) for i in range(40)]
    got = U.convert_quantities(spark.createDataFrame(rows + hidden, PAYLOADS), units(spark)).where("payload_id >= 1000").collect()
    right = [r for r in got if r.status == "predicted" and r.amount == (4_000_000 if r.payload_id % 2 else 512_000)]
    assert len(right) >= 36
    assert all(r.status in ("predicted", "review") for r in got)


def test_more_metrics_than_bins(spark):
    many = {f"metric {i}": ("mass", "mg") for i in range(90)}
    table = spark.createDataFrame([(m, q, u) for m, (q, u) in many.items()], "metric string, quantity string, common_unit string")
    rows = [(i, "result", str(1 + i % 7), ("g", "mg")[i % 2], f"metric {i % 90}", None, None, None, None, None) for i in range(360)] + [(900, "result", "3", None, "metric 4", None, None, None, None, None)]
    got = {r.payload_id: r.status for r in U.convert_quantities(spark.createDataFrame(rows, PAYLOADS), table).collect()}
    assert len(got) == 361 and got[900] in ("predicted", "review")


def test_few_labelled_payloads_still_teach(spark):
    rows = [(i, "result", "5" if i % 2 else "5000", "g" if i % 2 else "mg", "sample mass", None, None, None, None, None) for i in range(12)] + [(50, "result", "5", None, "sample mass", None, None, None, None, None)]
    got = {r.payload_id: r for r in U.convert_quantities(spark.createDataFrame(rows, PAYLOADS), units(spark)).collect()}
    assert got[50].status == "predicted" and got[50].amount == 5_000_000


def test_held_out_quality(spark):
    rows = [(i, "result", f"0.00{1 + i % 9}" if i % 2 else str(500_000 + i), "kg" if i % 2 else "µg", "sample mass", None, None, None, None, None) for i in range(300)]
    held = U.held_out(spark.createDataFrame(rows, PAYLOADS), units(spark)).collect()
    assert len(held) > 30 and sum(r.written == r.predicted for r in held) == len(held)
