"""Small corpora with odd rows, and plain versions of what operators compute."""

from __future__ import annotations

import random
import re
from pathlib import Path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use inside.
CLASH = "doc long, row string, node long, t string, k string, h long, part int, n int"
DATA = Path("/root/testdata/sf0.001")

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def sentence(rng: random.Random, n: int = 9, vocabulary: int = 4000) -> str:
    w = [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    return w[0].capitalize() + " " + " ".join(w[1:]) + "."


def prose(rng: random.Random, sentences: int = 12) -> str:
    return " ".join(sentence(rng, rng.randrange(6, 13)) for _ in range(sentences))


def odd_rows(start: int) -> list[tuple]:
    """Null, empty and blank texts, null metadata, a null key, a very long text, short texts, repeated rows, any signs."""
    rng = random.Random(start)
    long = " ".join(f"x{rng.randrange(30000)}" for _ in range(30000))
    rows = [
        (start, None, "en", "a", 0), (start + 1, "", None, None, None), (start + 2, " \n\t\x0b ", "en", "a", 5), (None, "a null key has text too", None, None, 1),
        (start + 3, long, "en", "b", len(long)), (start + 4, "one", "en", "b", 3), (start + 5, "Two words", None, "b", 9), (start + 6, "\U0001f600 émigré – naïve\r\nÑandú ﬁ \x00 x", "es", None, -1),
        (start + 7, "same row", "en", "c", 8), (start + 7, "same row", "en", "c", 8), (start + 7, "same key other text", "en", "c", 8), (start + 8, "###@@@+++...((()))", "", "", 2**40),
    ]
    return rows


def frame(spark, rows: list[tuple], clash: bool = False):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in CLASH.split(", ")})
    return df


def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)
