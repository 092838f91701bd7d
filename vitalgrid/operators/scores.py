"""Severity scores over the grid: organ sub-scores and total, kidney-injury stages."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.operators.grid import Exists, Input, Locf, RollingMin, Score, SegmentedRollingSum, Sources, WindowedLocf, evaluate, evaluate_together
from vitalgrid.schema import f32

DAY = "24h"

# Limits and grades of the scores (fixed values).
CREATININE = ((5.0, 4), (3.5, 3), (2.0, 2), (1.2, 1))
URINE = ((200, 4), (500, 3))
PLATELETS = ((20, 4), (50, 3), (100, 2), (150, 1))
BILIRUBIN = ((12.0, 4), (6.0, 3), (2.0, 2), (1.2, 1))
COMA = ((6, 4), (10, 3), (13, 2), (15, 1))


def at_least(value: Column, limits: tuple) -> Column:
    """Grade of the first limit that the value reaches, 0 below all, null if unknown."""
    out = reduce(lambda w, x: w.when(value >= f32(x[0]), x[1]), limits, F)
    return out.when(value.isNotNull(), 0)


def below(value: Column, limits: tuple) -> Column:
    """Grade of the first limit that the value is below, 0 above all, null if unknown."""
    out = reduce(lambda w, x: w.when(value < f32(x[0]), x[1]), limits, F)
    return out.when(value.isNotNull(), 0)


def graded(inputs: dict[str, Input], grade: Column, observed: Column | None = None, triggers: set[str] | None = None, needs: frozenset[str] = frozenset()) -> Score:
    """The grade wherever something is observed (default: any input is known)."""
    seen = reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in inputs]) if observed is None else observed
    return Score(inputs, F.when(seen, grade), frozenset(triggers) if triggers else None, needs)


def over(score: Callable[..., Score]) -> Callable[..., DataFrame]:
    """The score as a function of its sources and options."""

    @wraps(score)
    def run(sources: Sources, *args, hot_rows: int | None = None, at_once: str | None = None, **options) -> DataFrame:
        return score(*args, **options).over(sources, hot_rows, at_once)

    return run


def renal_score(window: str = DAY, urine_output_gap: str | None = None) -> Score:
    inputs = {"creatinine": WindowedLocf(window=window), "urine_output": SegmentedRollingSum(window=window, gap=urine_output_gap or window)}
    return graded(inputs, F.greatest(at_least(F.col("creatinine"), CREATININE), below(F.col("urine_output").cast("float"), URINE)))


def coagulation_score(window: str = DAY) -> Score:
    return graded({"platelet_count": WindowedLocf(window=window)}, below(F.col("platelet_count"), PLATELETS))


def liver_score(window: str = DAY) -> Score:
    return graded({"total_bilirubin": WindowedLocf(window=window)}, at_least(F.col("total_bilirubin"), BILIRUBIN))


def cns_score(window: str = DAY) -> Score:
    return graded({"gcs_total": WindowedLocf(window=window)}, below(F.col("gcs_total"), COMA))


def cardiovascular_score(window: str = DAY) -> Score:
    """Pressor rates in mcg/kg/min, then mean arterial pressure; an unknown rate meets no condition."""
    names = ("mean_arterial_pressure", "dopamine_rate", "dobutamine_rate", "epinephrine_rate", "norepinephrine_rate")
    pressure, dopamine, dobutamine, epinephrine, norepinephrine = (F.col(n) for n in names)
    strong = F.greatest(epinephrine, norepinephrine)  # both share their limits; unknown ones are passed over
    grade = (
        F.when((dopamine > f32(15)) | (strong > f32(0.1)), 4)
        .when((dopamine > f32(5)) | (strong > f32(0)), 3)
        .when((dopamine > f32(0)) | (dobutamine > f32(0)), 2)
        .when(pressure < f32(70), 1)
        .otherwise(0)
    )
    return graded({n: WindowedLocf(window=window) for n in names}, grade)


def respiratory_score(window: str = DAY, ventilation_window: str | None = None) -> Score:
    """PaO2 / FiO2 in mmHg with FiO2 in percent; the two worst grades need ventilation."""
    inputs = {
        "O2_partial_pressure": WindowedLocf(window=window),
        "fraction_of_inspired_oxygen": WindowedLocf(window=window),
        "mechanical_ventilation_windows": WindowedLocf(window=ventilation_window) if ventilation_window else Locf(),
    }
    oxygen = F.col("fraction_of_inspired_oxygen")
    ratio = F.when(oxygen > 0, ((F.col("O2_partial_pressure") / oxygen).cast("float") * f32(100)).cast("float"))
    ventilated = F.coalesce(F.col("mechanical_ventilation_windows") > 0, F.lit(False))
    grade = F.when(ventilated & (ratio < 100), 4).when(ventilated & (ratio < 200), 3).when(ratio < 300, 2).when(ratio < 400, 1).otherwise(0)
    return graded(inputs, grade, observed=ratio.isNotNull())


def windowed_sum(terms: Sources, window: str = DAY) -> DataFrame:
    """Sum of the terms' current values; one that is missing counts as 0."""
    inputs = {n: WindowedLocf(window=window) for n in terms}
    return evaluate(terms, inputs, reduce(lambda a, b: a + b, [F.coalesce(F.col(n), f32(0)) for n in terms]))


def windowed_max(terms: Sources, window: str = DAY) -> DataFrame:
    """Largest of the terms' current values; no row where all are missing."""
    inputs = {n: WindowedLocf(window=window) for n in terms}
    return evaluate(terms, inputs, F.greatest(*terms) if len(terms) > 1 else F.col(next(iter(terms))))


SOFA = {
    "sofa_renal": renal_score, "sofa_coagulation": coagulation_score, "sofa_liver": liver_score,
    "sofa_cns": cns_score, "sofa_cardiovascular": cardiovascular_score, "sofa_respiratory": respiratory_score,
}
sofa_renal, sofa_coagulation, sofa_liver, sofa_cns, sofa_cardiovascular, sofa_respiratory = (over(s) for s in SOFA.values())


def sofa_total(sources: Sources, window: str = DAY, hot_rows: int | None = None, at_once: str | None = None) -> DataFrame:
    """Sum of the organ scores' current values; one that is missing counts as 0.  All from one grid; ``hot_rows`` and ``at_once`` as in ``grid.align``."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(n), f32(0)) for n in SOFA])
    return evaluate_together(sources, {name: score(window) for name, score in SOFA.items()}, window, total, hot_rows, at_once)


def aki_creatinine_score(window: str = DAY, baseline_window: str = "7d", acute_window: str = "48h", require_acute_rise: bool = True) -> Score:
    """Stage by the ratio to the baseline, the acute rise and renal replacement therapy."""
    inputs = {
        "creatinine": WindowedLocf(window=window),
        "baseline": RollingMin("creatinine", baseline_window),
        "acute_low": RollingMin("creatinine", acute_window),
        "renal_replacement_therapy": Exists(window=window),
    }
    now, therapy = F.col("creatinine"), F.col("renal_replacement_therapy")
    ratio = F.when(F.col("baseline") != 0, (now / F.col("baseline")).cast("float"))
    acute = (ratio >= f32(1.5)) | ((now - F.col("acute_low")) >= f32(0.3)) if require_acute_rise else F.lit(True)
    three = therapy | (ratio >= 3) | ((now >= 4) & acute)
    stage = F.when(three, 3).when(ratio >= 2, 2).when(acute, 1).when(now.isNotNull(), 0)
    return graded(inputs, stage, observed=now.isNotNull() | therapy)


def aki_urine_output_score(urine_output_gap: str | None = None, weight_concept: str = "patient_weight", default_weight_kg: float | None = None) -> Score:
    """Stage by the mean urine rate per kilogram over windows that were observed whole."""
    hours = {6: "urine_6h", 12: "urine_12h", 24: "urine_24h"}
    inputs: dict[str, Input] = {n: SegmentedRollingSum("urine_output", f"{h}h", gap=urine_output_gap) for h, n in hours.items()}
    inputs["weight"] = Locf(weight_concept)
    weight = F.col("weight") if default_weight_kg is None else F.coalesce("weight", f32(default_weight_kg))
    volume = {h: F.col(n).cast("float") for h, n in hours.items()}
    rate = {h: F.when(weight > 0, (v / (weight * f32(h))).cast("float")) for h, v in volume.items()}
    stage = F.when((volume[12] <= 0) | (rate[24] < f32(0.3)), 3).when(rate[12] < f32(0.5), 2).when(rate[6] < f32(0.5), 1).otherwise(0)
    seen = reduce(lambda a, b: a | b, [r.isNotNull() for r in rate.values()])
    return graded(inputs, stage, observed=seen, triggers={"urine_6h"}, needs=frozenset() if default_weight_kg is not None else frozenset({weight_concept}))


aki_creatinine, aki_urine_output = over(aki_creatinine_score), over(aki_urine_output_score)


def aki_stage(sources: Sources, window: str = DAY, urine_output_gap: str | None = None, hot_rows: int | None = None, at_once: str | None = None) -> DataFrame:
    """Larger of the current stages by creatinine and by urine output.  Both from one grid; ``hot_rows`` and ``at_once`` as in ``grid.align``."""
    parts = {"by_creatinine": aki_creatinine_score(window), "by_urine": aki_urine_output_score(urine_output_gap)}
    return evaluate_together(sources, parts, window, F.greatest(*parts), hot_rows, at_once)
