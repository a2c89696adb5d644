import random

import pytest

WORDS = "the of and thern onst ering tion blees edwh anth rely ough stea inor".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ly"]) for _ in range(n)).capitalize() + "."


def text(rng, n=8):
    return "".join(sentence(rng, rng.randint(5, 12)) + rng.choice([" ", "\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): ordinary, near and exact copies, null, empty, blank, odd and repeated rows."""
    rng = random.Random(5)
    base = [text(rng, rng.randint(1, 30)) for _ in range(60)]
    out = [(i, t) for i, t in enumerate(base)]
    for k in range(12):  # near copies and exact ones of a few
        words = base[k % 3].split(" ")
        if k % 2:
            words[rng.randrange(len(words))] = "changed"
        out.append((100 + k, " ".join(words)))
    out += [(200, None), (201, ""), (202, " \n\t "), (203, "one"), (204, "two words"), (205, "x" * 3000 + " y"), (206, "\x1c\x85  日本語 ñandú 🙂"), (7, base[7]), (7, base[7]), (300, base[9] + base[10]), (301, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names could clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2.0, [3]) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n_lines int, score double, items array<int>")


@pytest.fixture(scope="session")
def empty(spark, docs):
    return docs.limit(0)
