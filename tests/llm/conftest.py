import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox jumps over the lazy dog again and again " * 4000


def words(seed: int, n: int) -> str:
    """A text of invented words, the same for the same seed."""
    parts, state, out = ["the", "an", "er", "on", "sti", "ble", "ou", "re"], seed * 2654435761 % 2**32, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % 2**31
        out.append(parts[state >> 8 & 7] + parts[state >> 12 & 7] + parts[state >> 16 & 7] * (state >> 20 & 1))
    return " ".join(out)


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, extra=None):
        full = [(*r, *(None,) * (5 - len(r))) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for name, value in (extra or {}).items():
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit(value))
        return df

    return make


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names clash."""
    rows = [
        (1, words(1, 120), "en", "a", 1), (1, words(1, 120), "en", "a", 1), (2, words(1, 120), None, None, None),
        (3, None, "en", "a", 0), (4, "", "de", "b", 0), (None, words(2, 80), "de", "b", 1), (None, None, None, None, None),
        (5, LONG, "en", "a", len(LONG)), (6, "   \n\t ", None, "b", 6), (7, "!!! 123 é中\U0001f600 <|endoftext|>", "fr", "c", 9),
        (8, words(3, 60), "fr", "c", 1), (9, words(4, 70), "de", "b", 1), (9, words(5, 70), "de", "b", 1),
    ]
    names = ("score", "stats", "row", "shard", "slot", "key", "keys", "node", "ids", "found", "lang_pred", "sha", "n", "id", "mix_copy", "quality", "draw", "size")
    return docs_of(rows, {n: f"extra {n}" for n in names})


@pytest.fixture(scope="session")
def no_docs(docs_of):
    return docs_of([])
