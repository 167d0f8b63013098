from __future__ import annotations

import random

import pytest

from omnisales.llm.scratch import ship_package


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


VOCABULARY = [a + b for a in ("th", "an", "er", "ou", "st", "ing") for b in ("e", "on", "ar", "it", "es", "al")]


def prose(rnd: random.Random, words: int) -> str:
    return " ".join(rnd.choice(VOCABULARY) + rnd.choice(["", "", "", ",", "."]) for _ in range(words))


#: A name of each working column that the operators use inside, to clash with.
CLASHES = ("spans", "print", "items", "carried", "copy", "bands", "class_id", "component", "key", "place", "gone")


def documents(spark, rows, extra=True):
    """(doc_id, text) rows as a documents table with extra columns whose names the operators use inside."""
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    data = [(i, t, "en" if i is not None and i % 2 else "fr", "s", None if t is None else len(t)) for i, t in rows]
    if extra:
        columns += "".join(f", {c} string" for c in CLASHES)
        data = [(*r, *(["x"] * len(CLASHES))) for r in data]
    return spark.createDataFrame(data, columns)


def edge_rows(seed: int = 1):
    """Copies, shared passages at shifted places, repeated rows, an id with two texts, nulls, empty and long texts."""
    rnd = random.Random(seed)
    passage, other, long_text = prose(rnd, 60), prose(rnd, 49), prose(rnd, 6000)
    rows = [(i, prose(rnd, rnd.randint(1, 120))) for i in range(10, 20)]
    rows += [(20 + k, f"{prose(rnd, k)} {passage}\n{prose(rnd, 5)}") for k in range(1, 8)]
    rows += [(30, passage), (31, passage), (31, passage), (32, other), (33, other), (34, f"{other} the end")]
    rows += [(40, long_text), (41, prose(rnd, 30) + " " + long_text), (42, long_text[:20_000])]
    rows += [(50, None), (51, ""), (52, " \t\n"), (53, "one"), (54, "one"), (55, "é 漢字 🙂"), (None, passage), (None, None)]
    rows += [(70, "for " * 200), (71, "x " + "for " * 90), (72, "for " * 49), (73, "for " * 55 + "y " + "for " * 120)]
    rows += [(60, prose(rnd, 80)), (60, passage + " " + prose(rnd, 9)), (-5, passage + " minus five")]
    return rows
