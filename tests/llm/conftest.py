import pytest
from pyspark.sql import functions as F, types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, source]) tuples, with columns whose names clash with the operators' own."""

    def make(rows, extra=True):
        rows = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(rows, DOCS).repartition(3)
        if extra:
            for name in ("fp", "start", "ids", "_id", "rank", "component_id", "n_words", "text_", "kept", "size", "_pseudonymised", "_spans", "_mix_key", "_mix_n", "_near_id", "_near_fp", "_near_low", "c0", "changed", "a.b", "x`y"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


@pytest.fixture(scope="session")
def hard_texts():
    """Null, empty, blank, odd white space, very long, ties and repeats."""
    words = [f"w{i % 97}x{i % 31}" for i in range(60_000)]
    return [
        None, "", " \t\n\r\x0b\x0c ", "a", "a b c", "a b c a b c a b c", "één twee drie vier", "x\x1cy z",
        "line one\nline one\n\nline two\nline one\n", " ".join(words), "Same words here again", "Same words here again",
        "emoji 👩‍👩‍👧 and 日本語 text", "# * $ % & | < >", "don't stop; it's 3.14 (or 22/7)!", "<|endoftext|> in <|startoftext|> text</s>",
    ]
