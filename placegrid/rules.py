"""Fixed values of the planning rules. They are inputs to the operators, never buried in them."""

# Thresholds of the coverage gate, the room screen and the teacher reference points.
COVERAGE_THRESHOLD = 90.0
ROOM_SCREEN = 50.0
TEACHER_REFERENCES = {"ES": 35.0, "JHS": 36.0, "SHS": 80.0 / 3}

# The outer fence rule and the magnitude rule of the sensitivity run.
FENCE_FACTOR = 3.0
FENCE_MIN_GROUP = 10
MAGNITUDE_CHANGE = 0.10

# Category labels, in order of urgency.
PRIORITY_CATEGORIES = (
    "Priority 1", "Priority 2", "Priority 3", "Monitor", "No current pressure identified", "Data review",
)

# Sensitivity statuses, most serious change first.
SENSITIVITY_STATUSES = (
    "No suspected outliers", "Priority-sensitive", "Classification-sensitive", "Coverage-sensitive",
    "Magnitude-sensitive", "Stable",
)

# Reasons a measure is not assessed.
NO_ACTIVE = "no active public school"
NO_COMPLETE = "no school with complete enrollment"
LOW_COVERAGE = "coverage below 90%"
NO_ROOMS = "no usable classroom denominator"
LOW_LEARNER_COVERAGE = "learner coverage below 90%"
NO_LEVEL = "no active public school level"
LOW_LEVEL_COVERAGE = "an offered level is below 90% learner coverage"

# Technical members of a place dimension.
UNKNOWN = "UNKNOWN"
EXCLUDED = "EXCLUDED"

# Accented capitals and their plain form, for name keys.
ACCENTED = "ÑÁÉÍÓÚÜÀÈÌÒÙÂÊÎÔÛ"
PLAIN = "NAEIOUUAEIOUAEIOU"

# A maximum for a whole number typed from text, and the quarantine rate limit in percent.
INT_MAX = 2147483647
QUARANTINE_FAIL_PERCENT = 1.0

# Age bands of the school-age population.
AGE_BANDS = (
    ("Kindergarten age (5)", 5, 5), ("Elementary age (6-11)", 6, 11),
    ("Junior high age (12-15)", 12, 15), ("Senior high age (16-17)", 16, 17),
)
SCHOOL_AGES = (5, 17)
