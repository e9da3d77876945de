import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows, with columns whose
    names the operators use inside."""

    def build(rows, extra=True, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(parts)
        if extra:
            for c in ("row", "fp", "root", "key", "line", "part", "queue", "kind", "attempt", "component_id", "content"):
                df = df.selectExpr("*", f"'x' as {c}")
        return df

    return build
