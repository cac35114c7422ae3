import pytest


@pytest.fixture(scope="session")
def make(spark):
    """DataFrame of (doc_id, text, ...) rows with columns that could clash with the operators' own."""

    def build(rows, schema="doc_id bigint, text string"):
        df = spark.createDataFrame(rows, schema)
        for name in ("n", "cls", "size", "digest", "shard", "block", "copies", "row", "host", "label", "a", "b"):
            if name not in df.columns:
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return build
