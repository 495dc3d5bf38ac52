"""Column expressions (JVM-side, codegen-friendly)."""

from .labels import binarise, coerce_id, na_to_null, parse_multilabel, strict_cast
from .scores import argmax2, argmax_k, prob_class1, softmax_k
from .text import (clean_text, content_tokens, is_alpha, is_stop_word, ngrams,
                   sentences, stop_words_array, text_hash, tokenize, truncate_tokens)

__all__ = [
    "argmax2", "argmax_k", "binarise", "clean_text", "coerce_id", "content_tokens",
    "is_alpha", "is_stop_word", "na_to_null", "ngrams", "parse_multilabel",
    "prob_class1", "sentences", "softmax_k", "stop_words_array", "strict_cast",
    "text_hash", "tokenize", "truncate_tokens",
]
