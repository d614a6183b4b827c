"""Plausibility of codes for the patient's sex, per trajectory."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoline import fixed_values as fv
from chronoline.functions import scalars as c


@dataclass(frozen=True)
class SexRules:
    female_dx: tuple = fv.FEMALE_DX_PREFIXES
    male_dx: tuple = fv.MALE_DX_PREFIXES
    pregnancy_labs: tuple = fv.PREGNANCY_LAB_CODES
    female_drugs: tuple = fv.FEMALE_DRUG_PREFIXES
    male_drugs: tuple = fv.MALE_DRUG_PREFIXES


VIOLATIONS = (
    ("female_specific_icd_in_male", "diagnosis"), ("male_specific_icd_in_female", "diagnosis"),
    ("pregnancy_test_lab_in_male", "lab"),
    ("female_specific_atc_in_male", "drug"), ("male_specific_atc_in_female", "drug"),
)


def trajectory_sex(rows: DataFrame, keys: Sequence[str], order: str = "event_id") -> DataFrame:
    """Sex of the first known demographic row of each trajectory."""
    sex = c.normalize_sex("code")
    head = rows.filter(F.col("type") == fv.DEMOGRAPHICS).withColumn("sex", sex)
    return head.filter(F.col("sex").isNotNull()).groupBy(*keys).agg(
        F.min_by("sex", order).alias("sex"))


def _plain(code: str) -> str:
    return "".join(ch for ch in code.upper() if ch.isalnum())


def _violation(rules: SexRules) -> Column:
    plain = F.col("plain")
    male, female = F.col("sex") == "male", F.col("sex") == "female"
    dx = F.col("type") == fv.DIAGNOSIS
    drug = F.col("type").isin(*fv.MEDICATION_TYPES)
    lab = F.col("type") == fv.LAB
    prefixed = lambda codes: c.has_prefix("plain", [_plain(x) for x in codes])
    return (F.when(dx & male & prefixed(rules.female_dx), F.lit("female_specific_icd_in_male"))
            .when(dx & female & prefixed(rules.male_dx), F.lit("male_specific_icd_in_female"))
            .when(lab & male & plain.isin(*[_plain(x) for x in rules.pregnancy_labs]),
                  F.lit("pregnancy_test_lab_in_male"))
            .when(drug & male & prefixed(rules.female_drugs), F.lit("female_specific_atc_in_male"))
            .when(drug & female & prefixed(rules.male_drugs), F.lit("male_specific_atc_in_female")))


def judged_rows(rows: DataFrame, keys: Sequence[str], rules: SexRules = SexRules(),
                order: str = "event_id") -> DataFrame:
    """Rows with the trajectory's `sex`, the plain code and the broken rule, if any."""
    known = trajectory_sex(rows, keys, order)
    typed = rows.withColumn("plain", c.normalize_code("code")).join(known, list(keys), "left")
    return typed.withColumn("violation_type", _violation(rules))


def sex_plausibility(rows: DataFrame, keys: Sequence[str], rules: SexRules = SexRules(),
                     order: str = "event_id") -> DataFrame:
    """One row per trajectory: event denominators, violation counts and flags.

    Trajectories of unknown sex keep zeros.
    """
    judged = judged_rows(rows, keys, rules, order)
    known = F.col("sex").isNotNull() & (F.col("plain") != "")
    count = {name: F.count_if(F.coalesce(F.col("violation_type") == name, F.lit(False)))
             for name, _ in VIOLATIONS}
    base = judged.groupBy(*keys).agg(
        F.max("sex").alias("sex"),
        F.count_if(known & (F.col("type") == fv.DIAGNOSIS)).alias("n_diagnosis_events"),
        F.count_if(known & (F.col("type") == fv.LAB)).alias("n_lab_events"),
        F.count_if(known & F.col("type").isin(*fv.MEDICATION_TYPES)).alias("n_drug_events"),
        *[expr.alias(f"n_{name}_events") for name, expr in count.items()])
    icd = F.col("n_female_specific_icd_in_male_events") + F.col("n_male_specific_icd_in_female_events")
    atc = F.col("n_female_specific_atc_in_male_events") + F.col("n_male_specific_atc_in_female_events")
    base = base.withColumns({"n_any_sex_incompatible_icd_events": icd,
                             "n_any_sex_incompatible_atc_events": atc})
    base = base.withColumn("n_any_sex_incompatible_events",
                           icd + atc + F.col("n_pregnancy_test_lab_in_male_events"))
    flags = [n for n, _ in VIOLATIONS] + ["any_sex_incompatible_icd", "any_sex_incompatible_atc",
                                          "any_sex_incompatible"]
    return base.withColumns({f"has_{n}": (F.col(f"n_{n}_events") > 0).cast("int") for n in flags})


FLAGS = tuple(n for n, _ in VIOLATIONS) + (
    "any_sex_incompatible_icd", "any_sex_incompatible_atc", "any_sex_incompatible")


def sex_plausibility_summary(records: DataFrame, patient: str = "patient_id",
                             trajectory: str = "trajectory_id") -> DataFrame:
    """Denominators, trajectory rates and event rates per source."""
    known = F.col("sex").isNotNull()
    total = records.groupBy("source").agg(
        F.count_if(known).alias("known_sex_trajectory_denominator"),
        F.count_distinct(patient).alias("patient_count"),
        F.count_distinct(trajectory).alias("trajectory_count"),
        *[F.coalesce(F.sum(F.when(known, F.col(n))), F.lit(0)).alias(n)
          for n in ("n_diagnosis_events", "n_lab_events", "n_drug_events")],
        *[F.coalesce(F.sum(F.when(known, F.col(f"has_{n}"))), F.lit(0)).alias(f"has_{n}_trajectory_count")
          for n in FLAGS],
        *[F.coalesce(F.sum(F.when(known, F.col(f"n_{n}_events"))), F.lit(0)).alias(f"n_{n}_event_count")
          for n in FLAGS])
    rates = {f"has_{n}_trajectory_rate": F.try_divide(
        F.col(f"has_{n}_trajectory_count"), F.col("known_sex_trajectory_denominator")) for n in FLAGS}
    per = {
        "female_specific_icd_in_male_event_rate_per_diagnosis":
            ("n_female_specific_icd_in_male_event_count", "n_diagnosis_events"),
        "male_specific_icd_in_female_event_rate_per_diagnosis":
            ("n_male_specific_icd_in_female_event_count", "n_diagnosis_events"),
        "pregnancy_test_lab_in_male_event_rate_per_lab":
            ("n_pregnancy_test_lab_in_male_event_count", "n_lab_events"),
        "female_specific_atc_in_male_event_rate_per_drug":
            ("n_female_specific_atc_in_male_event_count", "n_drug_events"),
        "male_specific_atc_in_female_event_rate_per_drug":
            ("n_male_specific_atc_in_female_event_count", "n_drug_events"),
    }
    rates |= {name: F.try_divide(F.col(a), F.col(b)) for name, (a, b) in per.items()}
    return total.withColumns(rates)


def violating_codes(rows: DataFrame, keys: Sequence[str], rules: SexRules = SexRules(),
                    order: str = "event_id") -> DataFrame:
    """(keys, sex, code_type, violation_type, code, n): violating codes per trajectory.

    Diagnoses are shown as their reporting group.
    """
    judged = judged_rows(rows, keys, rules, order).filter(F.col("violation_type").isNotNull())
    kind = c.map_literal("violation_type", dict(VIOLATIONS))
    shown = F.when(F.col("type") == fv.DIAGNOSIS, c.code_group("plain")).otherwise(F.col("plain"))
    return (judged.withColumns({"code_type": kind, "shown": shown})
            .groupBy(*keys, "sex", "code_type", "violation_type", F.col("shown").alias("violating_code"))
            .agg(F.count(F.lit(1)).alias("n_events")))


def violating_code_summary(codes: DataFrame, records: DataFrame, patient: str = "patient_id",
                           trajectory: str = "trajectory_id") -> DataFrame:
    """Events, trajectories, patients and trajectory rate per source and violating code."""
    known = records.filter(F.col("sex").isNotNull()).groupBy("source").agg(
        F.count(F.lit(1)).alias("denominator"))
    grouped = codes.groupBy("source", "code_type", "violation_type", "violating_code").agg(
        F.sum("n_events").alias("event_count"), F.count_distinct(trajectory).alias("trajectory_count"),
        F.count_distinct(patient).alias("patient_count"))
    return grouped.join(known, "source", "left").withColumn(
        "trajectory_rate", F.try_divide("trajectory_count", "denominator"))
