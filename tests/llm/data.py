"""Small tables with the awkward cases that every operator must define."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: names that operators use for their own columns
CLASHING = (
    "score string, kept string, ids string, predicted string, h string, key string, block string,"
    " bands string, n_tokens string, lang_pred string, decoded string, n_chunks string, _key string"
)
SYLLABLES = {
    "en": "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split(),
    "de": "sch ung ein ich ber ach keit ver ge zu und lich ten heit aus bei für ß ü ö".split(),
}


def sentence(rnd: random.Random, words: int, lang: str = "en") -> str:
    parts = SYLLABLES[lang]
    return " ".join("".join(rnd.choices(parts, k=rnd.randint(1, 4))) for _ in range(words)) + "."


def corpus(seed: int = 5, documents: int = 60) -> list[tuple]:
    """Documents in two languages with exact copies, near copies and repeated lines."""
    rnd = random.Random(seed)
    rows = []
    for i in range(documents):
        lang = "de" if i % 3 == 0 else "en"
        text = "\n".join(sentence(rnd, rnd.randint(5, 30), lang) for _ in range(rnd.randint(2, 6)))
        if i % 7 == 3:
            text, lang = rows[-1][1:3]
        elif i % 7 == 5:
            words = rows[-1][1].split(" ")
            words[len(words) // 2] = "changed"
            text, lang = " ".join(words), rows[-1][2]
        elif i % 11 == 6:
            text = text + "\n" + text.split("\n")[0] * 2 + "\n" + text
        rows.append((i, text, lang, f"s{i % 4}", len(text)))
    return rows


def messy() -> list[tuple]:
    """Nulls in every column, empty, blank, symbol-only and long texts, repeated rows and ids."""
    rnd = random.Random(9)
    long_text = " ".join(sentence(rnd, 12) for _ in range(1200))
    same = sentence(rnd, 40)
    return [
        *corpus(seed=8, documents=12),
        (None, None, None, None, None),
        (None, same, None, "s0", 1),
        (100, None, "en", None, None),
        (101, "", "en", "s1", 0),
        (102, " \n\t ", None, "s1", 4),
        (103, "### $$$ 12345 !!!", "de", "s1", 17),
        (104, long_text, "en", "s2", len(long_text)),
        (105, "x" * 70_000, None, "s2", 70_000),
        (106, same, "en", "s3", 1), (106, same, "en", "s3", 1), (106, "another text of id 106", "en", "s3", 1),
        (107, same, "en", "s3", 1),
        (108, "one", "en", "s3", 3),
        (109, "日本語 ▁   mixed\x1cspaces <|endoftext|> here", "en", "s3", 3),
    ]


def frame(spark, rows: list[tuple], clash: bool = False):
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    if clash:
        from pyspark.sql import functions as F

        for field in CLASHING.split(", "):
            df = df.withColumn(field.strip().split(" ")[0], F.lit("theirs"))
    return df
