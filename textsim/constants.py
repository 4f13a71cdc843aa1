"""Fixed values.

Everything in this module is a value that has to equal the behaviour being
reproduced (weights, cut-points, word lists, character sets).  They are stated
plainly and in their natural order so that they can be checked by eye.
"""

from __future__ import annotations

import math

# --- fixed values: pair-score weights (calibrated configuration) -----------
# Lexical mode (no semantic component).
WEIGHTS = {"cosine": 0.2, "jaccard": 0.30000000000000004, "ngram": 0.5, "semantic": 0.0}
# Semantic mode (hard-coded in the calibration step, never re-tuned).
WEIGHTS_WITH_SEMANTIC = {"cosine": 0.25, "jaccard": 0.15, "ngram": 0.15, "semantic": 0.45}
# Used when no configuration is present.
DEFAULT_WEIGHTS = {"cosine": 0.20, "jaccard": 0.30, "ngram": 0.50, "semantic": 0.0}
DEFAULT_WEIGHTS_WITH_SEMANTIC = {"cosine": 0.25, "jaccard": 0.15, "ngram": 0.15, "semantic": 0.45}
# Fallback weights of the final evaluation when the grid search found nothing.
FALLBACK_EVAL_WEIGHTS = (0.40, 0.30, 0.30)
# Calibrated decision threshold, in percent.
PLAGIARISM_THRESHOLD = 31.0

# --- fixed values: 5-level classification of the rounded overall score ----
CLASS_CUTS = [
    (15.0, "Original"),
    (30.0, "Low Similarity"),
    (50.0, "Moderate Similarity"),
    (75.0, "High Similarity"),
]
CLASS_TOP = "Very High Similarity (Likely Plagiarism)"
CLASS_NO_COMPARISON = "N/A (no comparison text)"

# --- fixed values: n-gram size, result caps, match threshold ---------------
NGRAM_N = 3
MAX_MATCHING_NGRAMS = 50
SEMANTIC_MATCH_THRESHOLD = 0.7
MAX_SEMANTIC_MATCHES = 30
REPORT_MATCHES = 15
REPORT_NGRAMS = 40
MAX_SOURCES = 20
REPORT_SOURCES = 10
QUERY_MAX_CHARS = 150
QUERY_MIN_WORDS = 6          # sentences need more than this many words
NUM_QUERIES = 5
NUM_RESULTS = 5

# --- fixed values: per-pair TF-IDF with smooth idf on two documents --------
# idf = ln((1 + n) / (1 + df)) + 1 with n = 2:  df = 2 -> 1,  df = 1 -> 1 + ln(1.5)
IDF_UNSHARED = 1.0 + math.log(1.5)
IDF_UNSHARED_SQ = IDF_UNSHARED * IDF_UNSHARED

# --- fixed values: ASCII punctuation (tokens that are a substring are dropped)
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# --- fixed values: English stopword list (Spark ML default English list) ---
STOPWORDS_EN = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself",
    "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as",
    "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through",
    "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off",
    "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how",
    "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don",
    "should", "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd", "he'd",
    "she'd", "we'd", "they'd", "i'm", "you're", "he's", "she's", "it's", "we're", "they're", "i've",
    "we've", "you've", "they've", "isn't", "aren't", "wasn't", "weren't", "haven't", "hasn't", "hadn't",
    "don't", "doesn't", "didn't", "won't", "wouldn't", "shan't", "shouldn't", "mustn't", "can't",
    "couldn't", "cannot", "could", "here's", "how's", "let's", "ought", "that's", "there's", "what's",
    "when's", "where's", "who's", "why's", "would",
]

# --- fixed values: word-tokenizer contractions (token -> two tokens) -------
CONTRACTIONS = [
    ("cannot", "can", "not"),
    ("gimme", "gim", "me"),
    ("gonna", "gon", "na"),
    ("gotta", "got", "ta"),
    ("lemme", "lem", "me"),
    ("wanna", "wan", "na"),
]

# --- fixed values: style-feature vocabularies ------------------------------
FUNCTION_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "need", "dare", "ought",
    "used", "to", "of", "in", "for", "on", "with", "at", "by", "from",
    "as", "into", "through", "during", "before", "after", "above", "below",
    "between", "out", "off", "over", "under", "again", "further", "then",
    "once", "and", "but", "or", "nor", "not", "so", "yet", "both",
    "either", "neither", "each", "every", "all", "any", "few", "more",
    "most", "other", "some", "such", "no", "only", "own", "same", "than",
    "too", "very", "just", "because", "if", "when", "where", "how", "what",
    "which", "who", "whom", "this", "that", "these", "those", "i", "me",
    "my", "we", "our", "you", "your", "he", "him", "his", "she", "her",
    "it", "its", "they", "them", "their",
]
CONJUNCTIONS = [
    "and", "but", "or", "nor", "yet", "so", "for", "both", "either", "neither",
    "while", "although", "however", "moreover", "furthermore", "additionally",
]
# Characters counted as punctuation by the style features.
STYLE_PUNCT_CHARS = ".,;:!?-()[]{}\"'"

STYLE_FEATURES = [
    "avg_sent_len", "sent_len_std", "type_token_ratio", "avg_word_len",
    "word_len_std", "hapax_ratio", "func_word_ratio", "punct_density",
    "comma_per_sent", "conj_density", "bigram_rep_ratio", "starter_diversity",
    "avg_para_len", "lexical_density", "log_length",
]

# --- fixed values: boosted-tree classifier ---------------------------------
GBT_PARAMS = {"maxIter": 200, "maxDepth": 5, "stepSize": 0.1, "minInstancesPerNode": 5,
              "subsamplingRate": 0.8, "seed": 42}
CV_FOLDS = 5
TEST_FRACTION = 0.2

# --- fixed values: labelled-pair generators --------------------------------
MINOR_EDIT_FILLERS = ["the", "a", "this", "that", "very", "quite", "rather"]
SYNONYMS = [
    ("important", "significant"), ("significant", "important"),
    ("large", "big"), ("big", "large"),
    ("help", "assist"), ("assist", "help"),
    ("use", "utilize"), ("utilize", "use"),
    ("make", "create"), ("create", "make"),
    ("show", "demonstrate"), ("demonstrate", "show"),
    ("good", "beneficial"), ("beneficial", "good"),
    ("new", "novel"), ("novel", "new"),
    ("also", "additionally"), ("additionally", "also"),
    ("however", "nevertheless"), ("nevertheless", "however"),
    ("because", "since"), ("since", "because"),
    ("including", "encompassing"), ("encompassing", "including"),
    ("various", "diverse"), ("diverse", "various"),
    ("provide", "offer"), ("offer", "provide"),
    ("development", "advancement"), ("advancement", "development"),
    ("impact", "effect"), ("effect", "impact"),
    ("role", "function"), ("function", "role"),
    ("approach", "method"), ("method", "approach"),
    ("system", "framework"), ("framework", "system"),
    ("process", "procedure"), ("procedure", "process"),
]
# pair type -> (label, maximum rows, expected minimum overall score / 100)
PAIR_TYPES = {
    "identical": (1, 40, 0.95),
    "minor_edit": (1, 40, 0.65),
    "word_swap": (1, 40, 0.40),
    "shuffle_sentences": (1, 40, 0.55),
    "partial_copy": (1, 30, 0.25),
    "unrelated": (0, 60, 0.0),
    "unrelated_same_style": (0, 30, 0.0),
}
TRAIN_MIN_CHARS = 30
PAIR_MIN_CHARS = 100

# --- fixed values: calibration grids ---------------------------------------
# threshold sweep: 10.0, 10.5, ..., 49.5 (kept as integer half-points 20..99)
SWEEP_HALF_POINTS = (20, 100)
# weight grid: cosine 0.20..0.55 and jaccard 0.10..0.45 in 0.05 steps (integer
# twentieths), n-gram weight = remainder kept within [0.05, 0.5]; thresholds 10..49
GRID_COSINE_20THS = (4, 12)
GRID_JACCARD_20THS = (2, 10)
GRID_THRESHOLDS = (10, 50)

# --- fixed values: bands ---------------------------------------------------
SEVERITY_CUTS = (30.0, 50.0)
MATCH_BAND_CUTS = (0.9, 0.8)

# --- fixed values: ingest --------------------------------------------------
SUPPORTED_EXTENSIONS = ["pdf", "docx", "txt"]
MAX_UPLOAD_BYTES = 16 * 1024 * 1024
