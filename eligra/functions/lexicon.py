"""Fixed word lists and tables of the criteria parsers, in their natural order.

Every value in this module is a fixed value: results depend on it being exactly so.
"""

# Lab terms with their item ids; the first term found in a line wins.
LAB_TERMS = {
    "creatinine": "50912", "hemoglobin": "51222", "glucose": "50931", "potassium": "50971", "sodium": "50983",
    "platelet": "51265", "bilirubin": "50885", "albumin": "50862", "wbc": "51301", "hematocrit": "51221",
    "inr": "51237", "bun": "51006", "lactate": "50813", "troponin": "51002", "hba1c": "50852",
}

# Medication terms; the first one found as a bare substring wins.
MEDICATION_TERMS = (
    "metformin", "insulin", "warfarin", "heparin", "aspirin", "statin", "furosemide", "lisinopril", "metoprolol",
    "amiodarone", "digoxin", "clopidogrel", "prednisone", "chemotherapy", "antibiotic", "anticoagulant",
    "beta-blocker", "ace", "inhibitor", "diuretic",
)

# Condition phrases with their ICD-10 category; the first phrase found wins.
CONDITION_PREFIXES = {
    "heart failure": "I50", "congestive heart failure": "I50", "myocardial infarction": "I21",
    "coronary artery disease": "I25", "atrial fibrillation": "I48", "hypertension": "I10", "hyperlipidemia": "E78",
    "diabetes": "E11", "type 2 diabetes": "E11", "type 1 diabetes": "E10", "diabetes mellitus": "E11",
    "chronic kidney disease": "N18", "acute kidney injury": "N17", "renal failure": "N19", "pneumonia": "J18",
    "sepsis": "A41", "septic shock": "R65", "copd": "J44", "chronic obstructive pulmonary disease": "J44",
    "asthma": "J45", "respiratory failure": "J96", "stroke": "I63", "anemia": "D64", "atrial flutter": "I48",
    "obesity": "E66", "depression": "F32", "cirrhosis": "K74", "gastrointestinal bleeding": "K92",
    "pulmonary embolism": "I26", "deep vein thrombosis": "I82", "cancer": "C80", "breast cancer": "C50",
    "lung cancer": "C34", "hypothyroidism": "E03",
}

# Condition phrases with a full code, matched as whole words, longest first.
MANUAL_CODES = {
    "heart failure": "I509", "congestive heart failure": "I509", "myocardial infarction": "I219",
    "heart attack": "I219", "diabetes mellitus": "E119", "diabetes": "E119", "pneumonia": "J189", "sepsis": "A419",
    "septic shock": "A419", "acute kidney injury": "N179", "chronic obstructive pulmonary disease": "J449",
    "copd": "J449", "stroke": "I639", "cerebrovascular accident": "I639", "atrial fibrillation": "I480",
    "hypertension": "I10", "hyperlipidemia": "E785", "cancer": "C80.1", "breast cancer": "C50.9",
    "lung cancer": "C34.90", "colorectal cancer": "C18.9", "prostate cancer": "C61", "leukemia": "C95.9",
    "lymphoma": "C85.9", "multiple sclerosis": "G35", "rheumatoid arthritis": "M06.9", "osteoarthritis": "M19.90",
    "depression": "F32.9", "anxiety": "F41.9", "schizophrenia": "F20.9", "alzheimer's disease": "G30.9",
    "alzheimer disease": "G30.9", "parkinson's disease": "G20", "parkinson disease": "G20", "epilepsy": "G40.909",
    "migraine": "G43.909", "asthma": "J45.909", "chronic kidney disease": "N189", "liver disease": "K76.9",
    "hepatitis": "B19.9", "hiv": "B20", "tuberculosis": "A15.9", "covid-19": "U07.1", "covid19": "U07.1",
    "influenza": "J11.1", "urinary tract infection": "N39.0", "deep vein thrombosis": "I82.409",
    "pulmonary embolism": "I26.99",
}

# Clinical synonyms with their ICD-10 category, matched as whole words, longest first.
CLINICAL_SYNONYMS = {
    "mi": "I21", "heart attack": "I21", "myocardial infarction": "I21", "prior mi": "I21", "history of mi": "I21",
    "stemi": "I21", "nstemi": "I21", "afib": "I48", "a-fib": "I48", "atrial fibrillation": "I48",
    "atrial flutter": "I48", "chf": "I50", "heart failure": "I50", "congestive heart failure": "I50", "hfref": "I50",
    "hfpef": "I50", "cad": "I25", "coronary artery disease": "I25", "coronary disease": "I25", "htn": "I10",
    "hypertension": "I10", "high blood pressure": "I10", "stroke": "I63", "cva": "I63",
    "cerebrovascular accident": "I63", "prior stroke": "I63", "ischemic stroke": "I63", "cerebral infarction": "I63",
    "tia": "G45", "transient ischemic attack": "G45", "dm": "E11", "diabetes": "E11", "diabetes mellitus": "E11",
    "type 2 diabetes": "E11", "t2dm": "E11", "type ii diabetes": "E11", "type 1 diabetes": "E10", "t1dm": "E10",
    "ckd": "N18", "chronic kidney disease": "N18", "renal failure": "N18", "esrd": "N18",
    "end stage renal disease": "N18", "aki": "N17", "acute kidney injury": "N17", "copd": "J44",
    "chronic obstructive pulmonary disease": "J44", "asthma": "J45", "pneumonia": "J18", "ards": "J80",
    "sepsis": "A41", "septic shock": "A41", "bacteremia": "A41", "tb": "A15", "tuberculosis": "A15", "cancer": "C80",
    "malignancy": "C80", "carcinoma": "C80", "tumor": "C80", "cirrhosis": "K74", "liver failure": "K72",
    "hepatic failure": "K72", "depression": "F32", "anxiety": "F41", "dementia": "F03", "obesity": "E66",
    "anemia": "D64",
}

# Recoding of criteria by the first phrase found in their text.
RECODE_BY_PHRASE = {
    "heart failure": "I509", "congestive heart failure": "I509", "myocardial infarction": "I219",
    "heart attack": "I219", "atrial fibrillation": "I480", "hypertension": "I10", "high blood pressure": "I10",
    "hyperlipidemia": "E785", "coronary artery disease": "I2510", "angina": "I200", "diabetes": "E119",
    "diabetes mellitus": "E119", "type 2 diabetes": "E119", "type 1 diabetes": "E101", "obesity": "E669",
    "pneumonia": "J189", "copd": "J449", "chronic obstructive pulmonary disease": "J449", "asthma": "J45909",
    "chronic kidney disease": "N189", "ckd": "N189", "acute kidney injury": "N179", "renal failure": "N189",
    "sepsis": "A419", "stroke": "I639", "cancer": "C809", "anemia": "D649", "pain": "R529",
}

# Acronyms a line may consist of, with type and code.
ACRONYMS = {
    "mci": ("diagnosis", "33183"), "vad": ("diagnosis", "29040"), "dlb": ("diagnosis", "33182"),
    "inph": ("diagnosis", "3315"), "mmse": ("lab", "MMSE_SCORE"), "cdr": ("diagnosis", "CDR_SCORE"),
    "ad": ("diagnosis", "3310"),
}

# Exact concept names of the standardiser.
STANDARD_DIAGNOSES = {"type 2 diabetes": "E119", "type 2 diabetes mellitus": "E119", "acute kidney failure": "N179",
                      "hypertension": "I10", "heart failure": "I509"}
STANDARD_LABS = {"hba1c": "50852", "hemoglobin a1c": "50852", "serum creatinine": "50912", "creatinine": "50912",
                 "glucose": "50931"}
STANDARD_PRESCRIPTIONS = {"metformin": "00093104801", "insulin": "00002821501", "lisinopril": "00006020715"}

# Phrases of administrative lines.
ADMINISTRATIVE_PHRASES = (
    "informed consent", "consent form", "legally authorized representative", "caregiver", "willingness to comply",
    "willing to comply", "willing to provide", "study visit", "study site", "investigator", "signature", "assent",
    "contraception", "birth control", "insurance", "reimbursement", "transportation to", "appointment",
    "questionnaire completion",
)

# Terms too generic to be a concept.
GENERIC_TERMS = (
    "blood", "urine", "csf", "plasma", "serum", "stool", "sputum", "swab", "fluid", "specimen", "sample", "tissue",
    "other", "unknown", "unspecified", "nos", "nec", "misc", "miscellaneous", "various", "test", "panel",
)

# Endings of generic drug names, and capitalised words that are no drug names.
DRUG_SUFFIXES = (
    "cillin", "mycin", "statin", "olol", "pril", "sartan", "azole", "oxetine", "mab", "nib", "tinib", "parin",
    "floxacin", "dipine", "zosin", "triptan", "prazole", "glitazone", "gliptin", "formin", "caine", "barbital",
    "zepam", "codone", "profen", "cycline",
)
CAPITALIZED_WORDS = (
    "the", "this", "these", "those", "patient", "patients", "subject", "subjects", "no", "not", "none", "any", "all",
    "must", "may", "will", "history", "current", "prior", "known", "age", "aged", "presence", "absence", "diagnosis",
    "diagnosed", "evidence", "participant", "participants", "female", "male", "women", "men", "adult", "adults",
)

# Words that are never an entity on their own.
STOP_ENTITIES = (
    "who", "that", "them", "their", "this", "these", "those", "patient", "patients", "participant", "participants",
    "subject", "subjects", "group", "groups", "use", "assessment", "score", "history", "the written icf", "icf",
    "legally acceptable representative", "a legal custodian", "legal custodian",
)

# Negation near an entity, and negation triggers before a span.
NEGATION_WORDS = ("no", "not", "without", "except", "exception", "excluding")
NEGATION_TRIGGERS = ("no", "not", "without", "except", "excluding", "denies", "never", "none", "absence", "free of",
                     "lack of", "without evidence of")

# Cues that a line is an exclusion whatever its section.
EXCLUSION_CUES = (
    "must not", "no history of", "without", "absence of", "excluded if", "not eligible", "cannot have",
    "contraindicat", "not permitted", "no prior", "no known", "not allowed", "must be free of", "no evidence of",
)

# Lab names that type a line with a number as a lab line.
LAB_HINTS = (
    "creatinine", "egfr", "gfr", "hemoglobin", "hgb", "hba1c", "a1c", "platelet", "bilirubin", "albumin", "sodium",
    "potassium", "glucose", "inr", "ast", "alt", "wbc", "neutrophil", "ejection fraction", "lvef", "bnp", "troponin",
    "ldl", "hdl", "triglyceride", "tsh", "psa",
)

# First words of boilerplate lines.
BOILERPLATE_LEADERS = ("willing", "able", "must", "should", "provide", "provides", "signe", "signed", "written",
                       "informed", "life expectancy", "performance status", "ecog", "karnofsky")

# Conditions of interest with their other names.
TARGET_CONDITIONS = {
    "heart failure": ("cardiac failure", "hf", "heart insufficiency", "congestive heart failure"),
    "myocardial infarction": ("heart attack", "mi", "acute coronary syndrome", "coronary thrombosis"),
    "diabetes": ("diabetes mellitus", "dm", "type 2 diabetes", "t2dm", "insulin-dependent"),
    "pneumonia": ("lung infection", "respiratory infection", "pneumonitis"),
    "sepsis": ("septicemia", "blood infection", "septic shock", "bacteremia"),
    "atrial fibrillation": ("afib", "af", "auricular fibrillation", "a-fib"),
    "hypertension": ("high blood pressure", "htn", "essential hypertension", "hypertensive"),
    "chronic kidney disease": ("ckd", "chronic renal failure", "renal insufficiency", "kidney disease"),
}

# Keywords that type a line when no code is found, tried in this order.
TYPE_KEYWORDS = {
    "medication": ("medication", "drug", "treatment", "therapy"),
    "lab": ("creatinine", "glucose", "blood", "pressure"),
    "procedure": ("surgery", "procedure", "transplant"),
}

# Operator words scanned in this order.
OPERATOR_WORDS = {
    ">": "GT", "greater than": "GT", "above": "GT", "higher than": "GT", ">=": "GTE",
    "greater than or equal": "GTE", "at least": "GTE", "<": "LT", "less than": "LT", "below": "LT",
    "lower than": "LT", "<=": "LTE", "less than or equal": "LTE", "at most": "LTE", "=": "EQ", "equal to": "EQ",
    "exactly": "EQ", "between": "BETWEEN", "exists": "EXISTS", "not exists": "NOT_EXISTS",
}
OPERATOR_SIGNS = {
    "<=": "LTE", "=<": "LTE", "≤": "LTE", "less than or equal to": "LTE", "<": "LT", "less than": "LT", ">=": "GTE",
    "=>": "GTE", "≥": "GTE", "greater than or equal to": "GTE", "at least": "GTE", ">": "GT", "greater than": "GT",
    "more than": "GT", "=": "EQ", "equal to": "EQ",
}

# Numeric bound patterns on lower-cased text, tried in this order.
BOUND_PATTERNS = (
    (r"\bbetween\s+([\d.]+)\s*(?:and|-|to)\s*([\d.]+)", "BETWEEN"),
    (r"(?:>=|≥|greater than or equal to|at least|no less than)\s*([\d.]+)", "GTE"),
    (r"(?:<=|≤|less than or equal to|at most|no more than|not exceed(?:ing)?)\s*([\d.]+)", "LTE"),
    (r"(?:>|greater than|above|exceeds?|higher than)\s*([\d.]+)", "GT"),
    (r"(?:<|less than|below|lower than|under)\s*([\d.]+)", "LT"),
    (r"(?:=|equal to|exactly)\s*([\d.]+)", "EQ"),
)

# A text that a pattern above fits contains one of these.
BOUND_CUES = {
    "BETWEEN": ("between",), "GTE": (">=", "≥", "greater than or equal to", "at least", "no less than"),
    "LTE": ("<=", "≤", "less than or equal to", "at most", "no more than", "not exceed"),
    "GT": (">", "greater than", "above", "exceed", "higher than"), "LT": ("<", "less than", "below", "lower than", "under"),
    "EQ": ("=", "equal to", "exactly"),
}

