"""Quantities recorded in different units, brought to the common unit of their metric.

A payload's metric is matched against the metric table (without regard to case, spaces, ``_``
and ``-``, and with a unit added to it or not). The unit counts where it is found first: the unit
field, the metric, the value, the text. The unit field, if filled with something that is not a
unit of the metric's quantity, makes the payload unreadable. The number is that of the value,
else the one before a unit of the quantity in the text.

Reading is done in Arrow batches with one pattern per quantity built from the unit table: as
built-in expressions the same patterns grow past what the JVM compiles.

Where a metric and a number are there but no unit is, a random forest (:class:`UnitModel`) says
which unit was meant, from the magnitude, the form of the number, the metric, the source (the
dataset) and the neighbouring fields. It is trained on readable payloads (at most
``TRAIN_AT_MOST`` of them, chosen by a hash of their id) and its confidence is calibrated by
isotonic regression on a held-out part of them; confident assignments are converted
(``predicted``), the others are left for ``review``.

Defined results: numbers too large for a bigint amount, and payloads with a null type, metric or
number, are ``unreadable``; exact duplicates are one payload; empty input gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_EVEN, Decimal
from functools import lru_cache

import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import cut, shuffle_width

METRICS_AT_MOST = 10_000
TRAIN_AT_MOST = 20_000
TRAIN_PARTITIONS = 4
CONFIDENT = 0.9

# Units by quantity as (factor to the quantity's base, offset added before the
# factor, symbols compared exactly, words compared without case).
UNITS: dict[str, list[tuple[float, float, str, str]]] = {
    "time": [
        (1e-6, 0, "µs us", "microsecond microseconds usec"), (1e-3, 0, "ms", "msec msecs millisecond milliseconds"), (1, 0, "s", "sec secs second seconds"),
        (60, 0, "min", "mins minute minutes"), (3600, 0, "h", "hr hrs hour hours"), (86400, 0, "d", "day days"), (604800, 0, "wk", "week weeks"),
    ],
    "mass": [
        (1e-9, 0, "ng", "nanogram nanograms"), (1e-6, 0, "µg ug mcg", "microgram micrograms"), (1e-3, 0, "mg", "milligram milligrams"), (1, 0, "g", "gram grams"),
        (1e3, 0, "kg", "kilo kilogram kilograms"), (1e6, 0, "t", "tonne tonnes"), (28.349523125, 0, "oz", "ounce ounces"), (453.59237, 0, "lb lbs", "pound pounds"),
    ],
    "length": [
        (1e-12, 0, "pm", "picometre picometres picometer picometers"), (1e-10, 0, "Å", "angstrom angstroms"), (1e-9, 0, "nm", "nanometre nanometres nanometer nanometers"),
        (1e-6, 0, "µm um", "micron microns micrometre micrometres micrometer micrometers"), (1e-3, 0, "mm", "millimetre millimetres millimeter millimeters"),
        (1e-2, 0, "cm", "centimetre centimetres centimeter centimeters"), (1, 0, "m", "metre metres meter meters"), (0.0254, 0, "in", "inch inches"),
    ],
    "temperature": [
        (1, 0, "°C degC", "deg~C degree~C degrees~C degree~Celsius degrees~Celsius celsius"), (1, -273.15, "K", "kelvin kelvins"),
        (5 / 9, -32, "°F degF", "deg~F degree~F degrees~F degree~Fahrenheit degrees~Fahrenheit fahrenheit"),
    ],
    "pressure": [
        (1, 0, "Pa", "pascal pascals"), (100, 0, "hPa mbar", "millibar millibars hectopascal hectopascals"), (1e3, 0, "kPa", "kilopascal kilopascals"), (1e6, 0, "MPa", "megapascal megapascals"),
        (1e5, 0, "bar", "bars"), (101325, 0, "atm", "atmosphere atmospheres"), (6894.757293168, 0, "psi", ""), (133.322387415, 0, "mmHg", ""), (101325 / 760, 0, "torr", "torr"),
    ],
    "amount concentration": [
        (1e-12, 0, "pM pmol/L", "picomolar"), (1e-9, 0, "nM nmol/L nmol/l", "nanomolar"), (1e-6, 0, "µM uM µmol/L umol/L umol/l µmol/l", "micromolar"),
        (1e-3, 0, "mM mmol/L mmol/l mol/m3 mol~m-3", "millimolar"), (1, 0, "M mol/L mol/l mol~L-1", "molar"),
    ],
    "volume": [
        (1e-9, 0, "nL nl", "nanolitre nanolitres nanoliter nanoliters"), (1e-6, 0, "µL uL µl ul", "microlitre microlitres microliter microliters"),
        (1e-3, 0, "mL ml cm3 cc", "millilitre millilitres milliliter milliliters"), (1, 0, "L l dm3", "litre litres liter liters"), (0.0295735295625, 0, "fl~oz", "fluid~ounce fluid~ounces"),
    ],
    "share": [(1, 0, "%", "percent per~cent pct"), (0.1, 0, "‰", "permil per~mille per~mil permille"), (100, 0, "", "fraction fractions")],
    "energy": [
        (1, 0, "J", "joule joules"), (1e3, 0, "kJ", "kilojoule kilojoules"), (1e6, 0, "MJ", "megajoule megajoules"), (4.184, 0, "cal", "calorie calories"),
        (4184, 0, "kcal", "kilocalorie kilocalories"), (3600, 0, "Wh", ""), (3.6e6, 0, "kWh", ""),
    ],
    "volume flow": [
        (1, 0, "mL/min ml/min mL~min-1 ml~min-1", "millilitres~per~minute milliliters~per~minute"), (60, 0, "mL/s ml/s mL~s-1 ml~s-1", "millilitres~per~second milliliters~per~second"),
        (1000, 0, "L/min l/min L~min-1 l~min-1", "litres~per~minute liters~per~minute"), (1000 / 60, 0, "L/h l/h L~h-1 l~h-1", "litres~per~hour liters~per~hour"),
        (1e-3, 0, "µL/min uL/min µl/min ul/min", "microlitres~per~minute microliters~per~minute"),
    ],
    "voltage": [(1e-9, 0, "nV", "nanovolt nanovolts"), (1e-6, 0, "µV uV", "microvolt microvolts"), (1e-3, 0, "mV", "millivolt millivolts"), (1, 0, "V", "volt volts"), (1e3, 0, "kV", "kilovolt kilovolts")],
}

_SPACE = r"[ \t\r\n    ]"
_GROUPED = r"(?:\d{1,3}(?:[,     ]\d{3})+(?!\d)|\d+)(?:[.,]\d+)?"
_POWER = rf"(?:{_SPACE}?[×x·*]{_SPACE}?10\^?[+\-−⁺⁻]?[\d⁰¹²³⁴⁵⁶⁷⁸⁹]+|[eE][+\-−]?\d+(?![\d]))?"
NUMBER = rf"[+\-−–]?{_GROUPED}{_POWER}"
#: A second number: the end of a range or a tolerance.
_SECOND = rf"(?:{_SPACE}*(?:±|\+/-|\+-|\.\.\.?|to|-|–|—|−){_SPACE}*{NUMBER})?"
_POWERS = str.maketrans("−–⁻⁺⁰¹²³⁴⁵⁶⁷⁸⁹", "---+0123456789")
_UNIT_SIGNS = str.maketrans({"μ": "µ", "Å": "Å", "⁻": "-", "⁰": "0", "¹": "1", "²": "2", "³": "3", "⁴": "4", "−": "-", "–": "-", "·": "~", "⋅": "~", "*": "~", "^": "", "℃": "°C", "℉": "°F"})
_VALUE = re.compile(rf"^[^\d]*?(?<![^\W_])({NUMBER}){_SECOND}{_SPACE}*(\D.*?)?{_SPACE}*$", re.S)
_FIRST = re.compile(rf"(?<![^\W_])(?<![.,])({NUMBER})")


def tidy_unit(text: str | None) -> str:
    """One notation for signs, powers and spaces; case is kept; blank is empty."""
    t = (text or "").translate(_UNIT_SIGNS)
    t = re.sub(rf"^{_SPACE}+|{_SPACE}+$", "", t)
    return re.sub(rf"{_SPACE}*~{_SPACE}*|{_SPACE}+", "~", t).replace("°~", "°")


@lru_cache(maxsize=None)
def notations(quantity: str) -> tuple[dict[str, tuple[float, float]], dict[str, tuple[float, float]]]:
    """Exact notations, and words in lower case, with (factor, offset)."""
    exact, words = {}, {}
    for factor, offset, symbols, names in UNITS[quantity]:
        exact.update({x: (factor, offset) for x in symbols.split()})
        words.update({x.lower(): (factor, offset) for x in names.split()})
    return exact, words


def find_unit(quantity: str, text: str | None) -> tuple[float, float] | None:
    """(factor, offset) of a unit of a quantity."""
    t = tidy_unit(text)
    exact, words = notations(quantity)
    return exact.get(t) or words.get(t.lower())


@lru_cache(maxsize=None)
def in_text(quantity: str) -> re.Pattern:
    """A number, perhaps a second one, and a unit of the quantity, inside a text."""

    def spell(x: str) -> str:
        x = re.escape(x).replace("µ", "[µμ]").replace("Å", "[ÅÅ]").replace("m\\-3", "m(?:\\^?[-−]3|⁻³)").replace("\\-1", "(?:\\^?[-−]1|⁻¹)").replace("m3", "m(?:\\^?3|³)")
        return x.replace("\\~", "~").replace("~", f"(?:{_SPACE}|[·⋅])*")

    exact, words = notations(quantity)
    extra = ["℃", "℉", f"°{_SPACE}C", f"°{_SPACE}F"] if quantity == "temperature" else []
    one = "|".join([*(spell(x) for x in sorted(exact, key=len, reverse=True)), *extra])
    two = "|".join(spell(x) for x in sorted(words, key=len, reverse=True))
    units = "|".join(x for x in (f"(?i:{two})" if two else "", one) if x)
    return re.compile(rf"(?<![^\W_])(?<![.,])({NUMBER}){_SECOND}{_SPACE}*({units})(?![^\W_])")


def numeral(text: str) -> float | None:
    """A number as written: a comma before exactly three digits groups, any other is decimal."""
    m = re.match(rf"([+\-−–]?)({_GROUPED})({_POWER})", text)
    if not m:
        return None
    g = re.match(r"(\d{1,3}(?:[,     ]\d{3})+(?!\d)|\d+)(?:[.,](\d+))?", m[2])
    power = re.sub(rf"^{_SPACE}?[×x·*]{_SPACE}?10\^?|^[eE]", "", m[3]).translate(_POWERS)
    sign = "-" if m[1] in ("-", "−", "–") else ""
    try:
        return float(f"{sign}{re.sub(r'[^0-9]', '', g[1])}.{g[2] or '0'}e{power or '0'}")
    except ValueError:
        return None


def to_common(number: float, unit: tuple[float, float], common: tuple[float, float]) -> int | None:
    """The amount in the common unit times 1000, rounded; nothing if it is no 64-bit number."""
    amount = ((number + unit[1]) * unit[0] / common[0] - common[1]) * 1000
    if not abs(amount) < 9.2e18:
        return None
    # Fifteen digits are what the numbers carry; halves are told by them.
    return int(Decimal(f"{amount:.15g}").quantize(Decimal(1), ROUND_HALF_EVEN))


@dataclass
class Metrics:
    """The metric table: name to (quantity, common unit), and a pattern of the names."""

    rows: dict[str, tuple[str, str]]

    @classmethod
    def of(cls, metric_units: DataFrame) -> Metrics:
        got = metric_units.select("metric", "quantity", "common_unit").where("metric is not null").distinct().limit(METRICS_AT_MOST + 1).collect()
        if len(got) > METRICS_AT_MOST:
            raise ValueError("too many metrics for a parameter table")
        return cls({" ".join(re.split(r"[\s_\-]+", r[0].strip().lower())): (r[1], r[2]) for r in got if r[1] in UNITS and find_unit(r[1], r[2])})

    def pattern(self) -> re.Pattern:
        spelled = "|".join(r"[\s_\-]+".join(map(re.escape, m.split())) for m in sorted(self.rows, key=len, reverse=True)) or "(?!)"
        return re.compile(rf"[\s_\-]*({spelled})(?:[\s_\-]*$|[\s_\-]*[,;:(\[/]\s*(.*?)\s*[\])]?\s*$|[\s_\-]+in\s+(.*?)\s*$|[\s_\-]+(\S.*?)\s*$)", re.I | re.S)


def read_one(rows: dict[str, tuple[str, str]], pattern: re.Pattern, value: str | None, unit: str | None, metric: str | None, text: str | None) -> tuple | None:
    """(metric, quantity, common unit, number, unit_from, factor, offset, amount) of one payload."""
    m = pattern.match(metric or "")
    if not m:
        return None
    name = " ".join(re.split(r"[\s_\-]+", m[1].lower()))
    quantity, common_unit = rows[name]
    v = _VALUE.match(value or "")
    first = _FIRST.search(value or "")
    t = in_text(quantity).search(text or "")
    number = numeral(first[1]) if first else None
    if number is None and t:
        number = numeral(t[1])
    found, source = None, None
    if tidy_unit(unit):
        found, source = find_unit(quantity, unit), "unit"
        if not found:
            source = "wrong"
    else:
        for source, candidate in (("metric", m[2] or m[3] or m[4]), ("value", v[2] if v else None), ("text", t[2] if t else None)):
            if candidate and (found := find_unit(quantity, candidate)):
                break
        else:
            source = None
    amount = to_common(number, found, find_unit(quantity, common_unit)) if found and number is not None else None
    return name, quantity, common_unit, number, source, found and found[0], found and found[1], amount


_READ = "metric_name string, quantity string, common_unit string, number double, unit_from string, factor double, offset double, amount bigint"
_KEPT = ["payload_id", "value", "unit", "metric", "text", "dataset", "condition"]


def _reader(rows: dict[str, tuple[str, str]], pattern: re.Pattern) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        for b in batches:
            got = [read_one(rows, pattern, *x) for x in zip(*(b[c].to_pylist() for c in ("value", "unit", "metric", "text")))]
            at = pa.array([i for i, x in enumerate(got) if x], pa.int64())
            cols = list(zip(*(x for x in got if x))) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([*(b[c].take(at) for c in _KEPT), *(pa.array(list(c), t) for c, t in zip(cols, types))], [*_KEPT, *(x.split(" ")[0] for x in _READ.split(", "))])

    return run


def read_payloads(payloads: DataFrame, metric_units: DataFrame) -> DataFrame:
    """What can be read of each payload of type ``result`` of a known metric, once a payload_id."""
    metrics = Metrics.of(metric_units)
    once = payloads.where(F.lower(F.trim("type")) == "result").where("metric is not null").select(*_KEPT).repartition(shuffle_width(payloads.sparkSession), "payload_id").dropDuplicates(["payload_id"])
    return once.mapInArrow(_reader(metrics.rows, metrics.pattern()), "payload_id bigint, value string, unit string, metric string, text string, dataset string, condition string, " + _READ)


class UnitModel:
    """Which unit was meant where none is written.

    With fewer than two distinct units among the readable payloads nothing can be learnt, and all
    payloads without a unit go to review. With too few labelled payloads for a held-out part, the
    confidence is calibrated on the training payloads."""

    def __init__(self, read: DataFrame, trees: int = 24, depth: int = 9, seed: int = 11):
        self.trees, self.depth, self.seed = trees, depth, seed
        labelled = read.where("amount is not null").withColumn("label_text", F.concat_ws("|", "quantity", F.col("factor").cast("string"), F.col("offset").cast("string")))
        total = max(1, labelled.count())
        draw = F.pmod(F.xxhash64(F.lit(seed), "payload_id"), F.lit(1_000_000)) / 1_000_000
        limit = min(1.0, TRAIN_AT_MOST / total)
        # At most TRAIN_AT_MOST rows, so a few partitions hold them through all rounds of training.
        sample = cut(self._features(labelled.withColumn("draw", draw).where(F.col("draw") < limit)).repartition(TRAIN_PARTITIONS))
        facts = sample.agg(F.count_distinct("label_text").alias("labels"), F.count_distinct("metric_name").alias("m"), F.count_distinct("quantity").alias("q"), F.count_if(F.col("draw") >= 0.7 * limit).alias("held"), F.count_if(F.col("draw") < 0.7 * limit).alias("own")).first()
        self.ready = facts["labels"] >= 2
        if not self.ready:
            return
        parted = facts["held"] and facts["own"]
        train = sample.where(F.col("draw") < 0.7 * limit) if parted else sample
        held = sample.where(F.col("draw") >= 0.7 * limit) if parted else sample
        if parted and train.select("label_text").distinct().count() < 2:
            train = held = sample
        self.pipeline = Pipeline(stages=[
            StringIndexer(inputCol="label_text", outputCol="label", handleInvalid="skip"),
            StringIndexer(inputCol="metric_name", outputCol="m", handleInvalid="keep"),
            StringIndexer(inputCol="quantity", outputCol="q", handleInvalid="keep"),
            VectorAssembler(inputCols=["m", "q", *self._NUMERIC], outputCol="features", handleInvalid="keep"),
            # A bin for each name, one for an unknown name, and no fewer than the numbers want.
            RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=max(64, facts["m"] + 1, facts["q"] + 1)),
        ]).fit(train)
        self.labels = self.pipeline.stages[0].labels
        judged = self._top(held).withColumn("right", (F.col("predicted_text") == F.col("label_text")).cast("double"))
        self.calibration = IsotonicRegression(featuresCol="raw", labelCol="right").fit(judged.select("raw", "right"))
        self.held = judged

    _NUMERIC = ["log10", "digits", "decimals", "whole", "negative", "has_text", "has_condition", "source"]

    def _features(self, df: DataFrame) -> DataFrame:
        v = F.coalesce("value", "text", F.lit(""))
        return df.withColumns({
            "log10": F.when(F.col("number") == 0, -30.0).otherwise(F.log10(F.abs("number"))),
            "digits": F.length(F.regexp_replace(v, r"[^\d]", "")).cast("double"),
            "decimals": F.length(F.regexp_extract(v, r"[.,](\d+)", 1)).cast("double"),
            "whole": (F.col("number") == F.floor("number")).cast("double"),
            "negative": (F.col("number") < 0).cast("double"),
            "has_text": F.col("text").isNotNull().cast("double"), "has_condition": F.col("condition").isNotNull().cast("double"),
            "source": F.pmod(F.xxhash64(F.coalesce("dataset", F.lit(""))), F.lit(32)).cast("double"),
        })

    def _top(self, df: DataFrame) -> DataFrame:
        # A label of another quantity is no unit of this one: the best of its own is taken.
        texts = F.array(*[F.lit(x) for x in self.labels])
        probability = vector_to_array("probability")
        own = F.filter(F.arrays_zip(probability.alias("p"), texts.alias("t")), lambda x: F.startswith(x["t"], F.concat("quantity", F.lit("|"))))
        scored = self.pipeline.transform(df).withColumn("own", F.array_sort(own, lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1).otherwise(0)))
        total = F.aggregate("own", F.lit(0.0), lambda acc, x: acc + x["p"])
        return scored.withColumn("predicted_text", F.get("own", F.lit(0))["t"]).withColumn("raw", F.coalesce(F.get("own", F.lit(0))["p"] / total, F.lit(0.0))).drop("own", "rawPrediction", "probability", "prediction", "features", "label", "m", "q")

    def predict(self, missing: DataFrame, confident: float = CONFIDENT) -> DataFrame:
        """Adds predicted_text, confidence and status to payloads without a unit."""
        if not self.ready:
            return missing.withColumns({"predicted_text": F.lit(None).cast("string"), "confidence": F.lit(0.0), "status": F.lit("review")})
        # StringIndexer of the label must see a label; none is there to be skipped.
        ready = self._features(missing).withColumn("label_text", F.lit(self.labels[0]))
        top = self.calibration.transform(self._top(ready)).withColumnRenamed("prediction", "confidence")
        return top.withColumn("status", F.when((F.col("confidence") >= confident) & F.col("predicted_text").isNotNull(), "predicted").otherwise("review"))


def held_out(payloads: DataFrame, metric_units: DataFrame, confident: float = CONFIDENT) -> DataFrame:
    """(payload_id, metric_name, written, predicted, confidence, confident): the model on labelled
    payloads it was not trained on, their unit hidden from it."""
    model = UnitModel(cut(read_payloads(payloads, metric_units)))
    if not model.ready:
        return payloads.sparkSession.createDataFrame([], "payload_id bigint, metric_name string, written string, predicted string, confidence double, confident boolean")
    judged = model.calibration.transform(model.held)
    return judged.select("payload_id", "metric_name", F.col("label_text").alias("written"), F.col("predicted_text").alias("predicted"), F.col("prediction").alias("confidence"), (F.col("prediction") >= confident).alias("confident"))


_OUT = ["payload_id", "metric_name", "quantity", "common_unit", "number", "unit_from", "amount", "status", "confidence"]


def convert_quantities(payloads: DataFrame, metric_units: DataFrame, confident: float = CONFIDENT) -> DataFrame:
    """Every result payload of a known metric, with its status: read, predicted, review, unreadable."""
    read = cut(read_payloads(payloads, metric_units))  # read for training, calibration and twice for the result
    model = UnitModel(read)
    known = read.where("unit_from is not null or number is null").withColumn("status", F.when(F.col("amount").isNotNull(), "read").otherwise("unreadable")).withColumn("confidence", F.when(F.col("amount").isNotNull(), 1.0))
    missing = model.predict(read.where("unit_from is null and number is not null"), confident)
    part = lambda k: F.get(F.split("predicted_text", r"\|"), F.lit(k)).cast("double")
    commons = Metrics.of(metric_units).rows
    of_metric = lambda k: F.element_at(F.create_map(*[F.lit(x) for m, (q, u) in commons.items() for x in (m, float(find_unit(q, u)[k]))]), F.col("metric_name"))
    if commons:
        scaled = F.round(((F.col("number") + part(2)) * part(1) / of_metric(0) - of_metric(1)) * 1000)
        missing = missing.withColumn("amount", F.when((F.col("status") == "predicted") & (F.abs(scaled) < 9.2e18), scaled.cast("bigint")))
    return known.select(*_OUT).unionByName(missing.select(*_OUT))
