import datetime

import pytest

#: Cases that every operator has to stand: null, empty, white space, long, repeated, odd characters.
ODD = [None, "", " ", "\n\n", "a", "word " * 3000, "é日本ß 🙂 x", "!!! *** ###", "same text here", "same text here", "x" * 5000, "'s 're\n \tend "]


@pytest.fixture(scope="session")
def odd_rows(spark):
    """Documents with nulls in every column, a repeated row, and columns whose names clash with what operators add."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", None if t is None else len(t), "mine", 1.5, 7, datetime.date(2020, 1, 1)) for i, t in enumerate(ODD)]
    rows += [rows[8], (None, "no id", "en", "s", 5, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string, score double, fp int, part date")


@pytest.fixture(scope="session")
def no_rows(odd_rows):
    return odd_rows.limit(0)
