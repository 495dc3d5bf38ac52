"""SQL text pieces for the DuckDB oracle: the driver-table views and the
portable regular expressions, written once and shared by every oracle query."""

from __future__ import annotations

from ..constants import ENGLISH_STOP_WORDS, ENSEMBLE_WEIGHTS, MEMBER_SHAPE, PCL_CATEGORIES
from ..functions.text import (ALPHA_PATTERN, HTML_ENTITY, HTML_TAG, SENTENCE_PATTERN,
                              TOKEN_PATTERN, WS_RUN)


def lit(s: str) -> str:
    """SQL string literal (DuckDB does not treat backslash as an escape)."""
    return "'" + s.replace("'", "''") + "'"


TOK = lit(TOKEN_PATTERN)
ALPHA = lit(ALPHA_PATTERN)
WORDCHAR = lit(r"[\p{L}\p{N}]")
STOP_LIST = "[" + ", ".join(lit(w) for w in ENGLISH_STOP_WORDS) + "]"
STOP_IN = "(" + ", ".join(lit(w) for w in ENGLISH_STOP_WORDS) + ")"
CATS = "[" + ", ".join(lit(c) for c in PCL_CATEGORIES) + "]"

PARA = """para AS (
  SELECT d.doc_id AS par_id, '@@' || CAST(d.doc_id AS VARCHAR) AS art_id,
         d.source AS keyword, d.lang AS country_code, d.text,
         CAST(CASE WHEN l.toxic = 1 THEN 2 + d.doc_id % 3 ELSE d.doc_id % 2 END AS INTEGER) AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

# The paragraph file with a position column; every seventh id occurs twice, the
# second time with another text.
FILED = """filed AS (
  SELECT *, par_id * 2 AS pos FROM para
  UNION ALL
  SELECT par_id, art_id, keyword, country_code, 'copy of ' || text AS text, label, par_id * 2 + 1 AS pos
  FROM para WHERE par_id % 7 = 0)"""

UNLAB = """unlab AS (
  SELECT d.doc_id AS id, '@@' || CAST(d.doc_id AS VARCHAR) AS art_id, d.source AS keyword,
         d.lang AS country_code, d.text, d.doc_id AS pos
  FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id))"""

DEV = """dev AS (
  SELECT doc_id AS par_id, '[0, ' || CAST(toxic AS VARCHAR) || ', 0]' AS label, doc_id AS pos
  FROM labels WHERE quality = 0)"""


def y_of(label: str = "label") -> str:
    return f"CAST(COALESCE({label} >= 2, false) AS INTEGER)"


def tokens_of(text: str = "text") -> str:
    return f"regexp_extract_all(lower({text}), {TOK})"


def clean_of(text: str) -> str:
    c = f"regexp_replace({text}, {lit(HTML_TAG)}, ' ', 'g')"
    c = f"regexp_replace({c}, {lit(HTML_ENTITY)}, ' ', 'g')"
    c = f"regexp_replace({c}, {lit(WS_RUN)}, ' ', 'g')"
    return f"trim({c})"


def content_of(tokens: str) -> str:
    return (f"list_filter({tokens}, lambda t: regexp_matches(t, {ALPHA}) "
            f"AND NOT list_contains({STOP_LIST}, t))")


def ngrams_of(tokens: str, n: int) -> str:
    """Space-joined n-grams of a list, inside one row."""
    return (f"CASE WHEN len({tokens}) >= {n} THEN list_transform(range(1, len({tokens}) - {n - 1} + 1), "
            f"lambda i: array_to_string({tokens}[i:i + {n - 1}], ' ')) ELSE [] END")


SENT = lit(SENTENCE_PATTERN)


def member_logits_cte() -> str:
    parts = []
    for (model, _), (strength, mult) in zip(ENSEMBLE_WEIGHTS.items(), MEMBER_SHAPE):
        parts.append(
            f"SELECT par_id, {lit(model)} AS model, 0.0::DOUBLE AS z0, "
            f"(CAST(label >= 2 AS INTEGER)::DOUBLE * 2.0 - 1.0) * {strength} "
            f"+ CAST((par_id * {mult}) % 97 - 48 AS DOUBLE) / 24.0 AS z1 FROM para")
    return "logits AS (\n  " + "\n  UNION ALL ".join(parts) + ")"


def weights_cte() -> str:
    rows = ", ".join(f"({lit(m)}, {w})" for m, w in ENSEMBLE_WEIGHTS.items())
    return f"weights(model, w) AS (VALUES {rows})"
