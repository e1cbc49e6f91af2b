"""Texts and schema that the tests of the text operators share."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    # names that the operators use inside
    T.StructField("id", T.StringType()), T.StructField("key", T.StringType()), T.StructField("code", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("_text", T.StringType()),
])
WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "ra", "so", "ti") for b in ("n", "st", "rd", "la", "vi", "xo", "que", "z")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def odd_texts() -> list[tuple[int | None, str | None]]:
    """Null and empty texts, ties, repeated rows, odd white space, a very long text, null and repeated ids."""
    long = prose(1, 30_000)
    return [
        (1, prose(2, 80)), (2, None), (3, ""), (4, "   \n\t "), (5, prose(2, 80)), (6, prose(3, 200)), (6, prose(3, 200)), (7, "one"), (8, "One two"),
        (9, long), (10, long + " end"), (None, prose(4, 40)), (None, None), (11, "a b  c\n\n\nd \r\n e\0f"), (12, "日本語 тест 😀 naïve <|endoftext|> it's 12 345"),
        (13, prose(3, 200).upper()), (14, "x" * 3000), (15, "\n" * 50), (6, prose(5, 30)), (16, " lead and trail "),
    ]
