"""Small tables with NULLs, empty and very long texts, ties, repeated rows and extra columns whose names clash with inner ones."""

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, id string, score double, label int, node long, keys array<int>, digest string, found string"


def prose(seed: int, words: int, stems=("the", "of", "tion", "ble", "ing", "an", "er", "ou", "sha", "nd")) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(words))


def documents(spark):
    long_text, copied = prose(1, 30_000), prose(2, 120)
    rows = [(1, copied), (2, copied), (3, copied + " one more word"), (4, ""), (5, None), (6, "  \n "), (7, long_text), (8, "Ab cD"), (9, "ab cd"),
            (10, "ab cd"), (11, prose(3, 80)), (11, prose(3, 80)), (None, prose(4, 60)), (None, None), (12, "x" * 5000), (13, "1234 5678 !!"),
            (14, "漢字 かな ́é <|endoftext|> <s> ▁▁ a\x00b\x1cc d"), (15, "word " * 3000)]
    full = [(i, t, "en" if i != 3 else None, None, None, "clash", 0.5, 7, 1, [1], "d", "f") for i, t in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def empty(df):
    return df.where("1 = 0")
