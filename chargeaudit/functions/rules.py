"""Rule lists and thresholds.  All are defaults of parameters; a user passes other lists the same way."""

from __future__ import annotations

from decimal import Decimal

# Keyword lists, in their order.
SURGICAL = ("operation", "surgery", "ot ", "ot charges", "ot assistant", "anesthet", "anaesthet", "surgeon", "procedure charges", "dressing", "assistant", "operative")
ROOM = ("room", "bed", "ward", "icu", "ccu", "nicu", "picu", "hdu", "deluxe", "private", "general ward", "semi-private", "suite")
ATOMIC = (
    "blood", "cbc", "lft", "rft", "kft", "test", "lab", "x-ray", "xray", "mri", "ct scan", "ultrasound", "ecg", "echo",
    "consultation", "consultant", "doctor", "specialist", "visit", "tablet", "syrup", "injection", "medicine", "drug",
    "stent", "implant", "catheter", "valve", "mesh",
)
ROOM_CATEGORIES = ("room charges", "room/ward rent", "room")
SURGICAL_CATEGORIES = ("procedure charges",)
CATEGORY_TOTALS = (
    "medicine charges", "medicines", "pharmacy", "pharmacy charges", "laboratory", "laboratory charges", "lab charges", "lab",
    "consumables", "consumable charges", "miscellaneous", "ip consultation", "op consultation", "consultation", "procedures",
    "procedure charges", "investigation", "investigations", "diagnostic charges", "nursing charges", "nursing", "service charges",
)
DISPATCH = {
    "drug": ("medicine", "drug", "tablet", "syrup", "injection"),
    "device": ("stent", "pacemaker", "implant", "catheter", "valve", "mesh", "prosthesis"),
    "diagnostic": ("ct scan", "mri", "x-ray", "xray", "ultrasound", "ecg", "echo", "lab", "test", "blood", "cbc"),
    "consultation": ("consultation", "consultant", "doctor", "specialist", "visit"),
    "consumable": ("consumable", "disposable"),
}
PROCEDURE_WORDS = (
    "surgery", "procedure", "angioplasty", "stent placement", "bypass", "valve replacement", "implant surgery", "ot charges", "ot charge",
    "operation", "operation theatre", "surgical", "laparoscopy", "endoscopy", "arthroscopy", "cath lab", "cathlab",
)
PROCEDURE_STOP_WORDS = ("with", "and", "the", "for", "left", "right", "under", "general", "local", "anaesthesia", "anesthesia", "procedure", "surgery")
DEPARTMENT_PREFIXES = (
    "obs & gynecology - ", "obs & gyne - ", "obs & gayne - ", "cardiology - ", "orthopedics - ", "general surgery - ",
    "deluxe ward - ", "icu - ", "general ward - ",
)
LAB_ISSUE_WORDS = ("blood", "urea", "crp", "culture", "count")
CONSUMABLES = ("tube", "vial", "accuvet", "lancet", "syringe", "needle", "swab", "container", "bottle", "specimen container", "blood colle", "collection tube")
POLICY_SECTIONS = (
    "exclusions", "coverage", "definitions", "sub-limits", "co-payment", "waiting period", "pre-existing", "claim procedure", "grievance", "sum insured", "room rent", "deductible", "copay", "daycare",
    "ambulance", "maternity", "pre-hospitalization", "post-hospitalization",
)
EXCLUSION_WORDS = (
    "pre-existing", "cosmetic", "dental", "eyeglasses", "hearing aids", "experimental", "not medically necessary", "elective", "self-inflicted", "war", "nuclear", "suicide", "intoxication", "pregnancy", "childbirth", "infertility",
)
SYNONYMS = {
    "lscs": "lower segment caesarean section",
    "c-section": "caesarean section",
    "cabg": "coronary artery bypass graft",
    "ptca": "percutaneous coronary angioplasty",
    "turp": "transurethral resection prostate",
    "tahbso": "total abdominal hysterectomy",
    "ot": "operation theatre",
    "icu": "intensive care unit",
    "mri": "magnetic resonance imaging",
    "ct": "computed tomography",
    "echo": "echocardiography",
    "ecg": "electrocardiogram",
    "ekg": "electrocardiogram",
}
PLACEHOLDERS = (
    "null", "none", "n/a", "na", "unknown", "not visible", "not specified", "not available", "not provided",
    "[hospital name]", "[bill number]", "[patient name]", "[insert", "tbd", "pending", "---", "___",
)
KEY_TERMS = (
    "cashless", "authorization", "claim", "settlement", "reimbursement", "grievance", "complaint", "ombudsman", "penalty", "interest",
    "bank rate", "policyholder", "insurer", "premium", "grace period", "portability", "renewal", "pre-authorization", "discharge",
)
CONFIDENCES = ("high", "medium", "low")
CONFIDENCE_RANK = {"high": 3, "medium": 2, "low": 1}
PACKAGE_TYPES = ("surgical_package", "room_stay_package", "missing_itemization")
CLAIM_TYPES = ("rejection_invalid", "rejection_delayed", "policy_violation")
LETTER_MATRIX = {
    "A_cash_clarification": ("hospital_clarification", "patient_summary"),
    "B_cash_objection": ("hospital_professional", "patient_summary"),
    "C_insurance_dispute": ("hospital_professional", "insurer", "patient_summary"),
    "D_hospital_overcharge_only": ("hospital_professional", "patient_summary"),
}
POSITION_SHARES = (Decimal("1.00"), Decimal("0.50"), Decimal("0.25"))
# Department, order, lowest and highest amount, procedure and its rate.
AMOUNT_BANDS = (
    ("obs & gynecology", 1, 20000, 30000, "Caesarean Section", 22000),
    ("obs & gynecology", 2, 10000, 15000, "Normal Delivery", 12000),
    ("obs & gynecology", 3, 40000, 60000, "Hysterectomy", 45000),
    ("cardiology", 1, 70000, 120000, "Angioplasty with Stent", 85000),
    ("cardiology", 2, 150000, 300000, "CABG (Bypass)", 200000),
    ("cardiology", 3, 50000, 80000, "Pacemaker Insertion", 60000),
    ("orthopedics", 1, 80000, 150000, "Knee Replacement", 120000),
    ("orthopedics", 2, 100000, 200000, "Hip Replacement", 150000),
    ("orthopedics", 3, 25000, 50000, "Fracture Fixation", 35000),
    ("general surgery", 1, 25000, 45000, "Appendectomy", 30000),
    ("general surgery", 2, 35000, 60000, "Hernia Repair", 45000),
    ("general surgery", 3, 50000, 100000, "Cholecystectomy", 65000),
)
