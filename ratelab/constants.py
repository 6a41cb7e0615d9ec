"""Values shared by the jobs."""

# Every list, table, number and pattern in this block is part of the data format or of
# a rule whose results must not change.

ACCENTS = ["American", "British", "Indian", "Chinese", "Nigerian"]
BASELINE_ACCENTS = ["American", "British"]
REFERENCE_ACCENT = "American"
PROMPT_ORDER = ["critical", "ideal", "native"]

RATING_LOW, RATING_HIGH = 1, 7

SCRIPTED_CATEGORIES = [
    "personal-introduction",
    "personal-commitment",
    "financial-product",
    "client-disagreement",
]
CORPUS_CATEGORIES = {
    "personal-introduction": "Personal-Introduction",
    "personal-commitment": "Personal-Commitment",
    "financial-product": "Financial-Product",
    "client-disagreement": "Client-Disagreement",
    "disagreement-unscripted": "Disagreement-Unscripted",
    "professional-introduction-unscripted": "Professional-Introduction-Unscripted",
}
CORPUS_PREFIXES = {
    "personal-introduction": "pi",
    "personal-commitment": "pc",
    "financial-product": "fp",
    "client-disagreement": "cd",
    "disagreement-unscripted": "du",
    "professional-introduction-unscripted": "piu",
}

FILLER_WORDS = [
    "um", "uh", "ah", "er", "hmm", "hm", "mm", "uhh", "umm", "ahh", "erm", "eh", "mhm", "mmm", "uhhh",
]
RATE_LIMIT_MARKERS = [
    "ratelimiterror", "rate_limit", "rate limit", "429", "resource_exhausted", "quota", "too many requests",
]
ERROR_PREFIX = "Error analyzing:"
TRANSCRIPT_ERROR_PREFIX = "Error analyzing"
FAILED = "FAILED"
FAILED_COUNT = -1
MAX_ATTEMPTS = 6

SAMPLE_RATE = 16000
INT16_SCALE, INT16_MIN, INT16_MAX = 32767, -32768, 32767
MIN_SEGMENT_SAMPLES = 400
FRAME_RATE = 50.0

MIN_REFERENCES = 2
MIN_SNR = 1.0
MIN_WORD_SECONDS = 0.20
EXCLUDED_WORDS = ["ira", "roth"]
MIN_POINTS = 3

BAND_POINTS = 200
BAND_MARGIN = 0.005
BAND_LEVEL = 0.975

CORPUS_NAME_FIXES = {
    "speaker_09": "speaker_09",
    "speaker_27": "speaker_27",
    "orevaoghene_ahia": "speaker_33",
}
SYNTHETIC_NAME_FIXES = {"ololade_awaye": "ololade"}

FEATURE_BY_WORD = {
    "strong": "Consonant cluster", "products": "Consonant cluster",
    "client": "Consonant cluster", "recently": "Consonant cluster",
    "experience": "Consonant cluster", "understand": "Consonant cluster",
    "technical": "Consonant cluster", "answer": "Consonant cluster",
    "friday": "Consonant cluster", "compliance": "Consonant cluster",
    "thursday": "Consonant cluster", "prioritizing": "Consonant cluster",
    "between": "Consonant cluster", "traditional": "Consonant cluster",
    "questions": "Consonant cluster", "suggested": "Consonant cluster",
    "explaining": "Consonant cluster", "scenarios": "Consonant cluster",
    "industry": "Consonant cluster", "agreeing": "Consonant cluster",
    "candidate": "Schwa reduction", "connection": "Schwa reduction",
    "customer": "Schwa reduction", "financial": "Schwa reduction",
    "appreciated": "Schwa reduction", "finishing": "Schwa reduction",
    "manager": "Schwa reduction", "basically": "Schwa reduction",
    "difference": "Schwa reduction", "retirement": "Schwa reduction",
    "example": "Schwa reduction", "acknowledged": "Schwa reduction",
    "tolerance": "Schwa reduction",
}
FEATURE_DEFAULT = "Other"

METADATA_COLUMNS = [
    "file_path", "category", "speaker_name_from_file", "name",
    "consent_18_plus", "data_sharing_consent", "age_range",
    "english_acquired_location", "native_language", "other_languages",
    "age_learned_english", "countries_lived", "gender", "uw_affiliation",
    "recording_device", "language_background_notes", "accent_nationality_origin",
    "audio_quality_rating", "quality_notes",
]
TRANSCRIPTION_COLUMNS = [
    "file_path", "category", "speaker_id", "accent", "model",
    "raw_transcription", "clean_transcription",
    "ref_word_count", "hyp_word_count", "edit_ops", "wer",
]
# End of fixed values.

# The texts that the analysis reader takes as missing.
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
)
