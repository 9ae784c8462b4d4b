import pytest

ODD = "id long, text string, doc_id long, lang string, source string, n_chars long, sketch string, spans string, ids string, stats string, node string, score string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and long texts, repeated rows, and extra columns named like results."""
    long = "alpha beta gamma delta " * 5000
    texts = [None, "", " \t\n", "12 !? 34", "one", "two words", "Hello there general reader of texts", "Hello there general reader of texts", long, "é ü ñ 😀 ▁ x", None]
    rows = [(i, t, i, [None, "en", "fr"][i % 3], [None, "a"][i % 2], None if t is None else len(t), "s", "p", "i", "t", "n", "z") for i, t in enumerate(texts)]
    rows.append((90, "no id here", None, "en", "a", 10, "s", "p", "i", "t", "n", "z"))
    rows.append(rows[6])
    return spark.createDataFrame(rows, ODD)
