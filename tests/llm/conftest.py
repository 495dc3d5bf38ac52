import os

import pytest

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) rows, with a column that clashes with results."""
    def make(rows, extra=()):
        data = [(i, t, "en", "s", None if t is None else len(t), *(7 for _ in extra)) for i, t in rows]
        return spark.createDataFrame(data, DOCS + "".join(f", `{c}` int" for c in extra))
    return make


@pytest.fixture(scope="session")
def sf_rows(spark):
    """doc_id and text of the small documents table, in Python."""
    rows = spark.read.parquet(os.path.join(SF, "documents.parquet")).select("doc_id", "text").collect()
    return [(r["doc_id"], r["text"]) for r in rows]


#: Nulls, empty and blank texts, ties, repeated rows, repeated ids, no id, one very long text.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c d e f"), (4, "a b c d e f"), (5, "a b c d e f"),
       (6, "A  B c d e f"), (None, "a b c d e f"), (7, "x " * 40_000), (8, "é́ 中文 \U0001f600 ▁ <|endoftext|>"),
       (4, "another text of the same id, long enough for a line")]
