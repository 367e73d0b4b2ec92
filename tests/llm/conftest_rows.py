import random

import pytest

#: Extra columns whose names clash with those that operators use inside.
EXTRA = {"id": 1, "key": 2, "node": 3, "label": 4, "piece": 5, "length": 6, "start": 7, "text_hash": 8, "p": 9, "q": 10, "x_rank": 11, "q_text": 12, "block": 13, "slot": 14, "offset": 15, "sequence_id": 16}
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
SCHEMA = COLUMNS + ", " + ", ".join(f"{c} int" for c in EXTRA)


def prose(n: int, seed: int, words: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice("bcdfgl") + str(rng.randint(0, words)) for _ in range(n))


def rows() -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows, copies and near copies."""
    base = prose(120, 1)
    near = " ".join("other" if i == 60 else w for i, w in enumerate(base.split()))
    passage = prose(70, 2)
    texts = {
        1: base,
        2: base,
        3: near,
        4: None,
        5: "",
        6: " \t\n",
        7: "one",
        8: "one two",
        9: "One TWO",
        10: prose(30_000, 3),
        11: prose(90, 4) + " " + passage,
        12: prose(60, 5) + "\n" + passage + "\n" + prose(40, 6),
        13: prose(100, 7),
        14: "é ü ß naïve " + prose(80, 8),
        15: "x " * 300,
        20: base,
    }
    out = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, None if t is None else len(t)) for i, t in texts.items()]
    out += [out[0], out[0], (None, prose(55, 9), "fr", "s1", 5), (None, base, None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(*r, *EXTRA.values()) for r in rows()], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def plain(spark):
    """The same with the columns of documents, non-null ids and without repeated rows."""
    return spark.createDataFrame(sorted({r for r in rows() if r[0] is not None}, key=lambda r: r[0]), COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
