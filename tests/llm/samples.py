"""Small tables with the cases every operator must handle."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))
LOOP = "the same words again and " * 3_000


def rows() -> list[tuple]:
    texts = {
        1: "The quick brown fox jumps over the lazy dog.",
        2: "the QUICK brown fox jumps over the lazy dog.",
        3: None,
        4: "",
        5: " \n\t ",
        6: LONG,
        7: "Ünïcode ÄÖÜ 😀 中文 " * 30,
        8: "one",
        9: LOOP,
        10: LONG + " end",
        11: "The quick brown fox jumps over the lazy dog.",
    }
    out = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in texts.items()]
    out.append((11, texts[11], "en", "src0", 44))  # a repeated row
    out.append((None, "a text without an id that is long enough to have a few shingles", None, None, None))
    out += [(100 + i, "copied many times over", "de", "src1", 22) for i in range(40)]
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def crowded(df):
    """The same rows with columns whose names the operators use themselves."""
    for name in ("_id", "_text", "_row", "row", "_digest", "_fp", "_key", "id", "h", "size", "shard", "label", "words", "rank", "item_id", "language", "_rank", "spans"):
        df = df.selectExpr("*", f"1 AS `{name}`")
    return df


def prose(seed: int, words: int, types: int = 400) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(types)}" for _ in range(words))
