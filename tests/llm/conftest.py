import random

import pytest

#: Names that the operators use inside: extra columns may bear them.
CLASHING = ("key", "word", "chunk", "at", "n", "rank", "_copy", "_spans", "kept", "fp", "id", "group", "shard", "first", "h", "ids", "found", "counted")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def frame(spark, rows):
    """Documents from (doc_id, text), with null and clashing columns beside them."""
    full = [(i, t, None if k % 3 == 0 else "en", "s", None if t is None else len(t), *("x",) * len(CLASHING)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(5)
    words = [a + b for a in ("th", "er", "on", "An", "rê", "ü") for b in ("e", "in", "ou", "st.", "é,", "42")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    a, b = text(120), text(60)
    rows = [(1, a), (2, None), (3, ""), (4, "   \n\t "), (5, b), (5, b), (6, a), (7, text(3000)), (8, a.replace("the", "THE")), (9, b + " " + text(30)), (10, "a " * 400), (11, "x"), (12, "ab cd"), (13, "ab cd"), (14, "#### $$$$ " * 30)]
    rows += [(20 + k, text(40) + "\n" + b[:150] + "\n\n" + text(20)) for k in range(12)] + [(40, "It's  odd,\x1c spaced　text…  \n ends "), (41, "漢字 and ไทย mixed 123"), (99, text(25))]
    return rows
