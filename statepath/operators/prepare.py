"""Projections, filters and renames on step tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from statepath.config import OUTPUT_COLUMNS, RESERVED_COLUMNS
from statepath.storage import join_lookup

# Feature codes and the display names they must be given.
FEATURE_NAMES = {
    "systolic_bp": "Systolic BP",
    "diastolic_bp": "Diastolic BP",
    "pulse": "Heart rate (pulse)",
    "resp": "Respiratory rate",
    "temp": "Temperature",
    "weight": "Weight",
    "fio2": "FiO2",
    "spo2": "SpO2",
    "sao2": "SaO2",
    "glucose": "Glucose",
    "magnesium": "Magnesium",
    "calcium": "Calcium",
    "sodium": "Sodium",
    "chloride": "Chloride",
    "hco3": "HCO3",
    "phosphate": "Phosphate",
    "potassium": "Potassium",
    "bun": "BUN",
    "creatinine": "Creatinine",
    "ck": "CK",
    "lactate": "Lactate",
    "hematocrit": "Hematocrit",
    "hemoglobin": "Hemoglobin",
    "wbc": "WBC",
    "platelet_count": "Platelets",
    "ldh": "LDH",
    "crp": "CRP",
    "esr": "ESR",
    "d_dimer": "D-Dimer",
    "inr": "INR",
    "pt": "PT",
    "ptt": "PTT",
    "high_sensitivity_crp": "hsCRP",
    "high_sensitivty_troponin": "hsTroponin",
    "total_bilirubin": "Total Bilirubin",
    "troponin": "Troponin",
    "conjugated_bilirubin": "Conjugated Bilirubin",
    "alt": "ALT",
    "ast": "AST",
    "albumin": "Albumin",
    "alkaline_phosphate": "Alkaline Phosphatase",
    "bnp": "BNP",
    "paco2": "PaCO2",
    "pao2": "PaO2",
    "ph": "pH",
    "total_sofa": "Total SOFA",
    "cardio_sofa": "Cardiovascular SOFA",
    "coag_sofa": "Coagulation SOFA",
    "liver_sofa": "Liver SOFA",
    "renal_sofa_new_renal": "Renal SOFA",
    "resp_sofa": "Respiratory SOFA",
    "cns_sofa": "CNS SOFA",
    "gcs": "GCS",
    "emesis": "Emesis output",
    "stool": "Stool output",
    "urine_6hr_sum": "Urine output - past 6hrs",
    "amt_left": "Fluid - ordered, not yet administered",
    "fluid_given_this_block": "Fluid - given this hour",
    "cumulative_fluid_past_6h": "Fluid - cumulative given past 6 hours",
}

# The features a profile expects, all display names above and MAP.
EXPECTED_FEATURES = ("MAP", *FEATURE_NAMES.values())


def clean_steps(steps: DataFrame) -> DataFrame:
    """Rows with a subject and a non-negative TIME."""
    return steps.where(F.col("ID").isNotNull() & (F.col("TIME") >= 0))


def cast_keys(steps: DataFrame) -> DataFrame:
    """ID to string; state, action and time columns to integer."""
    casts = {"ID": "string"}
    for name in ("TIME", "ACTION", "CLUSTER", "NEXT_CLUSTER"):
        casts[name] = "int"
    return steps.withColumns({c: F.col(c).cast(t) for c, t in casts.items() if c in steps.columns})


def combine_risk(steps: DataFrame, terms: Sequence[str] = ("total_sofa",)) -> DataFrame:
    """Add the term columns into RISK; null if any part is null."""
    total = F.col("RISK")
    for term in terms:
        total = F.col(term) + total
    return steps.withColumn("RISK", total)


def infer_features(steps: DataFrame) -> list[str]:
    """Every column that is not reserved, in table order."""
    return [c for c in steps.columns if c not in RESERVED_COLUMNS]


def output_columns(features: Sequence[str]) -> list[str]:
    return ["ID", "TIME", *features, *OUTPUT_COLUMNS]


def select_existing(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select([c for c in wanted if c in df.columns])


def drop_working(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def rename_features(df: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    return df.withColumnsRenamed(dict(FEATURE_NAMES if names is None else names))


def missing_features(df: DataFrame, expected: Sequence[str] = EXPECTED_FEATURES) -> DataFrame:
    """Expected features the table lacks, with the number of rows lacking them."""
    absent = [name for name in expected if name not in df.columns]
    return df.agg(F.count(F.lit(1)).alias("missing_rows")).select(
        F.explode(F.array(*[F.lit(n) for n in absent]) if absent else F.lit([]).cast("array<string>"))
        .alias("feature"),
        "missing_rows",
    )


def is_valid(df: DataFrame, columns: Sequence[str]) -> Column:
    """True where no column is null or NaN."""
    types = {f.name: f.dataType for f in df.schema.fields}
    tests = []
    for name in columns:
        tests.append(F.col(name).isNotNull())
        if isinstance(types[name], (DoubleType, FloatType)):
            tests.append(~F.isnan(name))
    return reduce(and_, tests, F.lit(True))


def skip_invalid(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows no model can use: any input null or NaN."""
    return df.where(is_valid(df, columns))


def count_invalid(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows kept and dropped by :func:`skip_invalid`, in one row."""
    valid = F.coalesce(is_valid(df, columns), F.lit(False))
    return df.agg(
        F.count_if(valid).alias("kept"),
        F.count_if(~valid).alias("dropped"),
    )


def labelled_only(steps: DataFrame) -> DataFrame:
    return steps.where(F.col("NEXT_CLUSTER").isNotNull())


def state_action_slice(steps: DataFrame, cluster: int, action: int) -> DataFrame:
    return steps.where((F.col("CLUSTER") == cluster) & (F.col("ACTION") == action))


def state_other_actions(steps: DataFrame, cluster: int, action: int) -> DataFrame:
    """Rows of the state with another action or none."""
    return steps.where((F.col("CLUSTER") == cluster) & ~F.col("ACTION").eqNullSafe(action))


def state_rest(steps: DataFrame, cluster: int) -> DataFrame:
    """Rows of all other states, and of none."""
    return steps.where(~F.col("CLUSTER").eqNullSafe(cluster))


def start_states(steps: DataFrame) -> DataFrame:
    """The first known state of every subject."""
    return steps.groupBy("ID").agg(F.min_by("CLUSTER", "TIME").alias("CLUSTER"))


def conditional_relabel(rows: DataFrame, new_cluster: int) -> DataFrame:
    """Sub-cluster 0 keeps its state, sub-cluster 1 becomes ``new_cluster``."""
    state = F.when(F.col("SUB") == 0, F.col("CLUSTER")).otherwise(F.lit(new_cluster))
    return rows.withColumn("CLUSTER", state.cast("int"))


def fill_terminal(df: DataFrame, column: str, fallback: str) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.col(fallback)))


def name_end_states(df: DataFrame, labels: DataFrame, index: str = "END_STATE") -> DataFrame:
    """Attach ``label`` from (END_STATE, label); ``state_<i>`` where there is none."""
    known = labels.select(F.col("END_STATE").alias(index), F.col("label").alias("_label"))
    fallback = F.concat(F.lit("state_"), F.col(index).cast("string"))
    return (
        join_lookup(df, known, [index], "left", salt_by=df.columns)
        .withColumn("label", F.coalesce(F.col("_label"), fallback))
        .drop("_label")
    )
