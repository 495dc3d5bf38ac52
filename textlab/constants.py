"""Fixed values that results depend on.

FIXED VALUES — these must stay as they are for results to match the
classifier project this engine re-implements.  They are stated plainly and
in their natural order.
"""

from __future__ import annotations

# FIXED VALUES: ensemble catalogue, in catalogue order, with soft-vote weights.
ENSEMBLE_WEIGHTS = {"RoBERTa": 1.2, "ModernBERT": 0.9, "MPNet": 0.9}
# FIXED VALUE: threshold on the weighted sum of P(class 1); strict ">".
ENSEMBLE_THRESHOLD = 1.38
# FIXED VALUES: class weights for the weighted cross-entropy, [class 0, class 1].
CLASS_WEIGHTS = (1.0, 9.0)
# FIXED VALUE: truncation length (tokens).
MAX_LENGTH = 128
# FIXED VALUES: label names for class 0 and class 1.
LABEL_NAMES = ("Non-PCL", "PCL")
# FIXED VALUE: a label >= this is the positive class.
POSITIVE_FROM = 2
# FIXED VALUES: percentiles of the length table.
PERCENTILES = (50, 75, 90, 95, 99)
# FIXED VALUE: seed of the stratified split.
SPLIT_SEED = 42
# FIXED VALUES: holdout share of the stratified split, val share of the holdout.
HOLDOUT_SHARE = 0.2
VAL_SHARE_OF_HOLDOUT = 0.5

# FIXED VALUES: the NA strings pandas' CSV reader turns into nulls.
NA_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# FIXED VALUES: the English stop-word list of the NLTK corpus (179 words),
# in its published order.
ENGLISH_STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you",
    "you're", "you've", "you'll", "you'd", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "she's", "her",
    "hers", "herself", "it", "it's", "its", "itself", "they", "them", "their",
    "theirs", "themselves", "what", "which", "who", "whom", "this", "that",
    "that'll", "these", "those", "am", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "having", "do", "does", "did",
    "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as",
    "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above",
    "below", "to", "from", "up", "down", "in", "out", "on", "off", "over",
    "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own",
    "same", "so", "than", "too", "very", "s", "t", "can", "will", "just",
    "don", "don't", "should", "should've", "now", "d", "ll", "m", "o", "re",
    "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't", "didn",
    "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't",
    "haven", "haven't", "isn", "isn't", "ma", "mightn", "mightn't", "mustn",
    "mustn't", "needn", "needn't", "shan", "shan't", "shouldn", "shouldn't",
    "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn",
    "wouldn't",
)

# FIXED VALUES: the seven span categories and the ten keywords of the
# labelled corpus (used for documentation and fixtures).
PCL_CATEGORIES = (
    "Unbalanced_power_relations", "Compassion", "Presupposition",
    "Authority_voice", "Metaphors", "Shallow_solution",
    "The_poorer_the_merrier",
)

# Shape of the derived member scores: (label strength, id multiplier) per
# catalogue position.
MEMBER_SHAPE = ((1.5, 31), (1.0, 53), (0.5, 71))
