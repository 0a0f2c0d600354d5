import public_tokenizers
import pytest

#: Texts with every kind of trouble: absent, empty, blank, one word, copies, near copies, other scripts, one very long.
WORDS = "the of and to in that is was for on with as his they at be this from have or one had by word but not what all were".split()


def sentence(seed: int, n: int) -> str:
    out = []
    for _ in range(n):
        seed = (seed * 1103515245 + 12345) % 2**31
        out.append(WORDS[seed >> 16 & 31 if (seed >> 16 & 31) < len(WORDS) else 0] + ("" if seed >> 8 & 3 else str(seed >> 20 & 7)))
    return " ".join(out)


BASE = sentence(1, 120)
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, BASE), (6, BASE), (7, BASE.upper()), (8, BASE.replace("that", "THAT", 1) + " tail"),
    (9, sentence(2, 400)), (10, "Grüße aus Köln, schöne Tage über alles müssen wir für die Änderung hören"), (11, "日本語のテキスト 漢字かな交じり文"), (12, "... 123 !!!"),
    (13, sentence(3, 60) + " " + BASE), (14, sentence(4, 30_000)), (15, "x" * 20_000), (16, "un texte en français où l'été est déjà passé"), (16, "un texte en français où l'été est déjà passé"),
    (None, BASE), (None, None),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Columns whose names operators use for their own results are there too."""
    rows = [(i, t, "en" if n % 3 else None, n, f"c{n}", [n]) for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int, score string, spans array<int>").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("doc_id = -5")


@pytest.fixture(scope="session")
def vocabulary():
    return public_tokenizers.path
