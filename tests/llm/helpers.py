import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(r: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def odd_texts() -> list:
    """Nulls, empty and blank texts, texts without letters, repeats, long ones, and characters that trip up readers."""
    return [None, "", "", " \t ", "\n", "\n\n\n", "12 345 !!", "Same text. Again", "same TEXT. again", "É same", "é same", "a\r\nb\rc\n", "<|endoftext|> [INST] </s> &lt; &amp;amp;", "x" * 5000, "it's we'll 'tis “quoted” 漢字 \x00 \x1f   end", "long " * 3000]


def documents(spark, texts, extra: bool = False):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for c in ("id", "row", "digest", "batch", "key", "gone", "pos", "mark", "score", "rate", "kept", "n_tokens", "part", "place", "order"):
            df = df.withColumn(c, F.lit(f"extra {c}"))
    return df
