"""Declared columns of the source and stage tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

S, D, TS = T.StringType(), T.DateType(), T.TimestampNTZType()
I, L, F64 = T.IntegerType(), T.LongType(), T.DoubleType()


@dataclass(frozen=True)
class TableSpec:
    """One source table: columns, required columns and value rules."""

    columns: dict
    not_null: tuple = ()
    unique: tuple = ()
    allowed: dict = field(default_factory=dict)
    optional: tuple = ()
    references_patient: bool = True
    exactly_one: tuple = ()

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, t) for n, t in self.columns.items()])


_ORDER = {"patient_id": S, "timestamp": TS, "item_code": S}
_DICTIONARY = TableSpec({"item_code": S, "item_name": S}, ("item_code", "item_name"),
                        ("item_code",), references_patient=False)

SOURCES = {
    "patients": TableSpec(
        {"patient_id": S, "sex": S, "first_name": S, "last_name": S, "date_of_birth": D},
        ("patient_id", "sex", "first_name", "last_name", "date_of_birth"),
        ("patient_id",), {"sex": ("M", "F", "O", "U", "A", "N")}, references_patient=False),
    "admissions": TableSpec(
        {"patient_id": S, "timestamp": TS, "department": S},
        ("patient_id", "timestamp"), optional=("department",)),
    "discharges": TableSpec(
        {"patient_id": S, "timestamp": TS, "disposition": I},
        ("patient_id", "timestamp", "disposition"), allowed={"disposition": (0, 1)}),
    "diagnoses": TableSpec(
        {**_ORDER, "provisional": I},
        ("patient_id", "timestamp", "item_code", "provisional"),
        allowed={"provisional": (0, 1)}),
    "prescription_orders": TableSpec(_ORDER, tuple(_ORDER)),
    "injection_orders": TableSpec(_ORDER, tuple(_ORDER)),
    "laboratory_results": TableSpec(
        {**_ORDER, "numeric": F64, "unit": S, "nonnumeric": S, "time_available": TS},
        tuple(_ORDER), optional=("time_available",), exactly_one=("numeric", "nonnumeric")),
    "diagnosis_codes": _DICTIONARY,
    "medication_codes": _DICTIONARY,
    "lab_test_codes": _DICTIONARY,
}

EVENT_VIEW = T.StructType([
    T.StructField("patient_id", S), T.StructField("type", I), T.StructField("age_min", L),
    T.StructField("code", S), T.StructField("text", S), T.StructField("result", S),
    T.StructField("train_period", I), T.StructField("test_period", I),
])

# Columns whose nulls drop a row while cleaning: any of the first list, or all
# of the second.
CLEANING_RULES = {
    "patients": (("patient_id", "sex", "date_of_birth"), ()),
    "admissions": (("patient_id", "timestamp"), ()),
    "discharges": (("patient_id", "timestamp", "disposition"), ()),
    "diagnoses": (("patient_id", "timestamp", "item_code", "provisional"), ()),
    "prescription_orders": (("patient_id", "timestamp", "item_code"), ()),
    "injection_orders": (("patient_id", "timestamp", "item_code"), ()),
    "laboratory_results": (("patient_id", "timestamp", "item_code"), ("numeric", "nonnumeric")),
}
