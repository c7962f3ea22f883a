"""Small documents with every awkward case: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

PASSAGE = " ".join(f"shared{i}" for i in range(60))


def texts() -> list[tuple]:
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["Ünïcode", "日本語", "x" * 50]
    prose = lambda n: "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", " "]) for _ in range(n))
    rows = [(i, prose(rng.randint(0, 120))) for i in range(60)]
    base = prose(200)
    rows += [(100 + i, base) for i in range(5)]
    rows += [(110 + i, base.replace("w1", f"q{i}", 3)) for i in range(5)]
    rows += [(130 + i, prose(30) + PASSAGE + " " + prose(30)) for i in range(6)]
    rows += [(140, None), (141, ""), (142, " \n\t"), (143, "one"), (144, "One"), (145, prose(20_000)), (146, "a b\r\nc"), (147, "a  b c"), (148, "x " * 45)]
    return rows


def documents(spark, rows=None, extra: bool = True):
    rows = texts() if rows is None else rows
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # names that operators use inside
    return df.selectExpr("*", "'k' AS k", "1 AS n", "'f' AS f", "0 AS component", "'s' AS source") if extra else df
