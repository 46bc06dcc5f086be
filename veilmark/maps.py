"""Type names, tag spellings, word lists, prefixes and thresholds of the evaluation."""

# Identifier types of the annotations and the tag that should replace each.
TAG_OF_TYPE = {
    "NAME": "NAME",
    "GEOGRAPHIC_LOCATION": "LOCATION",
    "DATE": "DATE",
    "MEDICAL_RECORD_NUMBER": "MRN",
    "HEALTH_PLAN_BENEFICIARY_NUMBER": "ID",
    "PHONE_NUMBER": "PHONE",
    "SOCIAL_SECURITY_NUMBER": "ID",
    "EMAIL_ADDRESS": "EMAIL",
    "UNIQUE_IDENTIFIER": "ID",
    "ACCOUNT_NUMBER": "ID",
    "FAX_NUMBER": "PHONE",
    "CERTIFICATE_LICENSE_NUMBER": "ID",
    "IP_ADDRESS": "ID",
}

# Spellings of tags and the tag that each stands for. A name that is listed nowhere stands for itself.
TAG_OF_SPELLING = {
    "NAME": "NAME",
    "PATIENT_NAME": "NAME",
    "PERSON": "NAME",
    "PATIENT": "NAME",
    "FIRST_NAME": "NAME",
    "LAST_NAME": "NAME",
    "FULL_NAME": "NAME",
    "DOCTOR": "NAME",
    "PHYSICIAN": "NAME",
    "CLINICIAN": "NAME",
    "LOCATION": "LOCATION",
    "PLACE": "LOCATION",
    "FACILITY": "LOCATION",
    "HOSPITAL": "LOCATION",
    "ADDRESS": "LOCATION",
    "CITY": "LOCATION",
    "STATE": "LOCATION",
    "COUNTRY": "LOCATION",
    "CLINIC": "LOCATION",
    "INSTITUTION": "LOCATION",
    "GEOGRAPHIC_LOCATION": "LOCATION",
    "DATE": "DATE",
    "DOB": "DATE",
    "VISIT_DATE": "DATE",
    "ADMISSION_DATE": "DATE",
    "DATE_OF_BIRTH": "DATE",
    "DISCHARGE_DATE": "DATE",
    "MRN": "MRN",
    "RECORD_NUMBER": "MRN",
    "MEDICAL_RECORD": "MRN",
    "CHART_NUMBER": "MRN",
    "MEDICAL_RECORD_NUMBER": "MRN",
    "PHONE": "PHONE",
    "TELEPHONE": "PHONE",
    "FAX": "PHONE",
    "PHONE_NUMBER": "PHONE",
    "FAX_NUMBER": "PHONE",
    "EMAIL": "EMAIL",
    "EMAIL_ADDRESS": "EMAIL",
    "ID": "ID",
    "SSN": "ID",
    "IDENTIFIER": "ID",
    "SOCIAL_SECURITY": "ID",
    "ACCOUNT": "ID",
    "LICENSE": "ID",
    "SOCIAL_SECURITY_NUMBER": "ID",
    "HEALTH_PLAN": "ID",
    "DEVICE_ID": "ID",
    "ACCOUNT_NUMBER": "ID",
}

# Names that a tag may hold, in the order in which they are tried.
TAG_NAMES = (
    "NAME", "PATIENT_NAME", "PERSON", "PATIENT", "FIRST_NAME", "LAST_NAME", "FULL_NAME", "DOCTOR", "PHYSICIAN",
    "CLINICIAN", "LOCATION", "PLACE", "FACILITY", "HOSPITAL", "ADDRESS", "CITY", "STATE", "COUNTRY", "CLINIC",
    "INSTITUTION", "GEOGRAPHIC_LOCATION", "DATE", "DOB", "VISIT_DATE", "ADMISSION_DATE", "DATE_OF_BIRTH",
    "DISCHARGE_DATE", "MRN", "RECORD_NUMBER", "MEDICAL_RECORD", "CHART_NUMBER", "MEDICAL_RECORD_NUMBER", "PHONE",
    "TELEPHONE", "FAX", "PHONE_NUMBER", "FAX_NUMBER", "EMAIL", "EMAIL_ADDRESS", "ID", "SSN", "IDENTIFIER",
    "SOCIAL_SECURITY", "SOCIAL_SECURITY_NUMBER", "ACCOUNT", "LICENSE", "HEALTH_PLAN", "DEVICE_ID", "ACCOUNT_NUMBER",
    "AGE", "URL", "REDACTED", "REMOVED", "PHI",
)

# Tags that stand for any type.
GENERIC_TAGS = ("UNKNOWN", "REDACTED", "REMOVED", "PHI")

# Words left out of token overlaps.
STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "could", "should", "may", "might", "shall", "can", "to", "of", "in", "for", "on", "with", "at",
    "by", "from", "as", "into", "through", "during", "before", "after", "above", "below", "between", "out", "off",
    "over", "under", "again", "further", "then", "once", "and", "but", "or", "nor", "not", "so", "if", "than",
    "that", "this", "these", "those", "it", "its", "he", "she", "they", "we", "you", "his", "her", "their", "our",
    "your", "what", "which", "who", "whom", "when", "where", "why", "how",
)

# Capitalised pairs of words that are no names.
NO_NAMES = (
    "New York", "United States", "African American", "Native American",
    "Emergency Room", "Intensive Care", "Blood Pressure", "Heart Rate",
)

# Clinical terms that should never be tagged.
CLINICAL_TERMS = (
    "diabetes", "copd", "ms", "afib", "gerd", "hypertension", "cancer", "asthma", "nsclc", "chf", "cad", "ckd",
    "metformin", "lisinopril", "atorvastatin", "aspirin", "surgery", "bypass", "hysterectomy", "chemotherapy",
)
# What gives away examples and explanations around a tag.
EXAMPLE_TERMS = ("for example", "such as", "e.g.", "like")
EXPLAINING_TERMS = ("replaced", "de-identified", "redacted", "removed")

# Prefixes that a direct answer may start with, in the order in which they are stripped.
ANSWER_PREFIXES = (
    "Output:", "Result:", "De-identified:", "Redacted:", "Answer:", "De-identified text:",
    "Here is the de-identified text:", "Here's the de-identified text:",
)
# Headings before the last section of an answer in sections, in the order in which they are tried.
SECTION_MARKERS = (
    "OUTPUT:", "Output:", "output:", "RESULT:", "Result:", "result:",
    "DE-IDENTIFIED TEXT:", "De-identified text:", "STEP 3:", "Step 3:",
)
# Answers that say that nothing was found.
NOTHING_FOUND = ("[]", "", "None", "No PHI found", "No PHI found.", "No PHI", "none", "NONE")

# Tolerances and thresholds.
TAG_DISTANCE = 80
DELETION_CONTEXT = 30
SIMILARITY_POSITIVE, SIMILARITY_NEGATIVE = 0.85, 0.90
RATIO_LOW, RATIO_HIGH, APPENDED = 0.80, 1.20, 1.3
EXPANDED = 1.2
TARGET_RECALL, TARGET_OVER_REDACTION = 95.0, 10.0
INFERENCES_A_CONFIGURATION = 3153

# The prompts that are no ablations, and the field of a model's name on its server.
PRIMARY_PROMPTS = ("zero-shot-minimal", "zero-shot-structured", "few-shot", "two-pass")
MODEL_TAG = "ollama_tag"
