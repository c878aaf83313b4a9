import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark, tmp_path):
    """Write rows of (doc_id, text[, lang]) as a documents table; returns (folder, frame)."""

    def make(rows, extra=""):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            df = df.selectExpr("*", *extra.split(", "))
        df.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))

    return make


#: Columns whose names clash with those that the operators make.
CLASHES = "1 as score, 'x' as row, 2 as n_tokens, 3 as shard, 4 as kept, 5 as component_id, 6 as predicted, 7 as band, 8 as rep, 9 as value"
EDGE = [(0, None), (1, ""), (2, "   \n\t"), (3, "word"), (4, "same text here twice over"), (5, "same text here twice over"), (5, "same text here twice over"), (None, "no key at all"), (None, None), (6, "é😀 Σας İ <|endoftext|> 'tis don't"), (7, "ab " * 60_000)]
