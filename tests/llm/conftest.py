import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, g string, b int, row string, score double, keep boolean, id string, n int, `o.p` string, m map<string,string>"


def make(spark, rows):
    """Documents with columns whose names operators use themselves; rows are (doc_id, text[, lang, source])."""
    full = []
    for r in rows:
        r = (*r, *(None,) * (4 - len(r)))
        full.append((r[0], r[1], r[2], r[3], None if r[1] is None else len(r[1]), 7, "g", 1, "row", 0.5, True, "id", 3, "dot", {"a": "b"}))
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture
def messy(spark):
    long = " ".join(f"word{i % 977} x{i % 31}" for i in range(60_000))
    return make(
        spark,
        [
            (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "a"),
            (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "a"),
            (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa", None, None),
            (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "a"),
            (3, None, "en", "a"),
            (None, None, None, None),
            (4, "", "en", "b"),
            (5, "", None, "b"),
            (6, "  \n\t ", "de", "b"),
            (7, long, "en", "b"),
            (8, long + " end", "en", None),
            (9, "!!! ??? ...", "fr", "b"),
            (10, "ÜBER été naïve 漢字 🙂", "fr", "b"),
            (11, "one", "en", "b"),
        ],
    )
