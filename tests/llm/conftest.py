import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents table from (doc_id, text) rows."""

    def make(*rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)

    return make


@pytest.fixture
def clash():
    """Adds columns whose names the operators use inside."""

    def add(df):
        from pyspark.sql import functions as F

        return df.withColumns({c: F.lit(f"own {c}") for c in ("_key", "_spans", "_k", "_hits", "_strong", "_weak", "_entities", "_near", "_score", "_host", "_path", "key", "id", "fp", "contamination_", "_gone", "_i", "_x", "score", "contamination", "repeats", "line_dedup", "secrets", "pii")})

    return add
