import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts, or (doc_id, text) or (doc_id, text, source)."""

    def make(rows, extra=False):
        full = []
        for i, r in enumerate(rows):
            r = (i, r) if not isinstance(r, tuple) else r
            full.append((r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")))
        df = spark.createDataFrame(full, DOCS).repartition(3)
        if extra:  # names that the operators use themselves
            for c in ("n", "node", "h", "row_no", "score", "size", "shard", "component_id", "kept", "key", "place", "target", "length", "bin", "grp", "p", "norm"):
                df = df.withColumn(c, df["lang"])
        return df

    return make
