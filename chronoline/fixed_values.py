"""Values that results depend on literally."""

# ---- Fixed values: record type numbers -------------------------------------
DEMOGRAPHICS = 0
ADMISSION = 1
DISCHARGE = 2
DIAGNOSIS = 3
PRESCRIPTION = 4
INJECTION = 5
LAB = 6
END_OF_TIMELINE = 7
MEDICATION_TYPES = (4, 5)

# ---- Fixed values: special tokens, in vocabulary order ---------------------
OPERATIONAL_TOKENS = (
    "[PAD]", "[DX]", "[MED]", "[LAB]", "[ADM]", "[DSC]", "[PRV]", "[EOT]", "[OOV]",
)
DISPOSITION_TOKENS = {0: "[DSC_EXP]", 1: "[DSC_ALV]"}
SEX_TOKENS = {"F": "[F]", "M": "[M]", "O": "[O]", "U": "[U]", "A": "[A]", "N": "[N]"}
PRESET_RESULT_TOKENS = {"(+)": "[pos]", "(-)": "[neg]", "(+-)": "[n/p]"}
OOV_INDEX = -2
IGNORED_LABEL = -1
PROVISIONAL_SUFFIX = "(prov.)"

# ---- Fixed values: token descriptions --------------------------------------
TOKEN_DESCRIPTIONS = {
    "[PAD]": "padding",
    "[DX]": "diagnosis code",
    "[MED]": "medication code",
    "[LAB]": "laboratory test code",
    "[ADM]": "admitted",
    "[DSC]": "discharged",
    "[PRV]": "provisional",
    "[DSC_ALV]": "survived",
    "[DSC_EXP]": "expired",
    "[M]": "male patient",
    "[F]": "female patient",
    "[O]": "other sex",
    "[U]": "unknown sex",
    "[A]": "ambiguous sex",
    "[N]": "sex not applicable",
    "[EOT]": "end of timeline",
    "[OOV]": "out of vocabulary",
}

# ---- Fixed values: strings read as null ------------------------------------
NULL_STRINGS = ("", "NA", "N/A", "na", "nan", "NaN", "NaT", "None", "none")

# ---- Fixed values: time-bin sections (first day, last day, step in days) ----
TIME_BIN_SECTIONS = ((1, 30, 1), (31, 180, 10), (181, 360, 30), (361, 1800, 180))

# ---- Fixed values: lab statistics ------------------------------------------
TRIM_PERCENT = 0.005
TRIM_MIN_COUNT = 19_999
LOGIT_EPS = 1e-7

# ---- Fixed values: formats -------------------------------------------------
DATE_FORMAT = "yyyy/MM/dd"
TIMESTAMP_FORMAT = "yyyy/MM/dd HH:mm"
AGE_TEXT_PATTERN = r"(\d+)Y/(\d+)M/(\d+)D (\d+):(\d+)"
LEADING_NUMBER_PATTERN = r"^([+-]?\d*\.?\d+(?:[eE][-+]?\d+)?)"
ANY_NUMBER_PATTERN = r"(\d+\.?\d*)"

# ---- Fixed values: diagnosis groups counted per patient --------------------
MAJOR_DIAGNOSES = {
    "cancer": r"^(C[0-8][0-9]|C9[0-7]|D0[0-9])",
    "hypertension": r"^I1[0-5]",
    "diabetes_mellitus": r"^E1[0-4]",
    "dyslipidemia": r"^E78",
}

# ---- Fixed values: event tasks, drug prefixes and minimum days -------------
DRUG_TASKS = {
    "broad_spectrum_antibiotic_use": (
        ("J01CA12", "J01CR05", "J01DE01", "J01DH", "J01GB12", "J01XA", "J01XB01",
         "J01XX08", "J01XX09"), 1),
    "broad_spectrum_antibiotic_use_gram_negative": (
        ("J01CA12", "J01CR05", "J01DE01", "J01DH", "J01GB12", "J01XB01"), 1),
    "broad_spectrum_antibiotic_use_gram_positive": (
        ("J01GB12", "J01XA", "J01XX08", "J01XX09"), 1),
    "anti-MRSA": (("J01XA", "J01XX08", "J01XX09"), 1),
    "glycopeptids": (("J01XA",), 1),
    "carbapenems": (("J01DH",), 1),
    "RBC_transfusion": (("B05AX01",), 1),
    "PLT_transfusion": (("B05AX02",), 1),
    "FFP_transfusion": (("B05AA02",), 1),
    "catecholamine_use": (("C01CA",), 1),
    "catecholamine_use_gte_2": (("C01CA",), 2),
}

# ---- Fixed values: event tasks, lab thresholds -----------------------------
LAB_TASKS = {
    "serum_sodium": ("3H0100000023---01", "mmol/L",
                     (120, 125, 130, 135), (145, 150, 155, 160)),
    "serum_potassium": ("3H0150000023---01", "mmol/L",
                        (2.0, 2.5, 3.0, 3.5), (5.0, 5.5, 6.0, 6.5, 7.0)),
    "serum_chloride": ("3H0200000023---01", "mmol/L",
                       (85, 90, 96), (106, 110, 115, 120)),
}
CREATININE = {"code": "3C0150000023---01", "unit": "mg/dL", "plus": 0.3, "times": 1.5}
NEUTROPENIA = {
    "wbc_code": "2A9900000019---52", "wbc_unit": "×10^3/μL", "wbc_const": 1000,
    "neutrophil_codes": ("2A1600000019---51", "2A1600000034---51"),
    "neutrophil_unit": "%", "thresholds": (100, 500),
}

# ---- Fixed values: sex-plausibility rules ----------------------------------
FEMALE_DX_PREFIXES = (
    "O", "Z32", "Z33", "Z34", "Z35", "Z36", "Z37", "Z39", "C53", "C54", "C55", "C56",
    "N80", "N91", "N92", "N95", "Q50", "Q51", "Q52",
)
MALE_DX_PREFIXES = (
    "N40", "N41", "N42", "N43", "N44", "N45", "N46", "N47", "N48", "C60", "C61", "C62",
    "C63", "D29", "Q53", "Q54", "Q55", "Z125",
)
PREGNANCY_LAB_CODES = ("4F0800000001---01", "4F0800000023---01",
                       "4F0900000001---01", "4F0900000023---01")
FEMALE_DRUG_PREFIXES = ("G02AB01",)
MALE_DRUG_PREFIXES = ()

# ---- Fixed values: record id prefixes --------------------------------------
RECORD_ID_PREFIXES = {
    "patients": "PT", "laboratory_results": "LABRSLT", "admissions": "ADM",
    "discharges": "DSC", "diagnoses": "DX", "prescription_orders": "PRSCORD",
    "injection_orders": "INJCORD",
}
