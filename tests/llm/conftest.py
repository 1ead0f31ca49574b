import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, size long, digest string, key long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) + rng.choice("xyz") + str(rng.randint(0, 99)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and long texts, copies, near copies, shared lines and passages, repeated ids; clashing extra columns."""
    rng = random.Random(5)
    base = [prose(rng, 60) for _ in range(24)]
    near = [" ".join(w if i % 50 else "changed" for i, w in enumerate(b.split())) for b in base[:4]]
    lines = "\n".join(prose(rng, 8) for _ in range(12))
    passage = prose(rng, 70)
    texts = [
        *base, *near, *near, base[0], base[0], base[1], None, None, "", " \n\t ", "one", "one", "two words", "Ünï cödé ß  日本", "'s don't <|endoftext|> STOP",
        lines, prose(rng, 9) + "\n" + lines, lines + "\n" + prose(rng, 9), prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 30), prose(rng, 25) + "\n" + passage,
        " ".join(base) * 12,
    ]
    sources = ["a", "b", None, "Z", "a", "a"]
    out = [(100 + i if i % 17 else i, t, "en", sources[i % 6], None if t is None else len(t), i, -1, "x", None) for i, t in enumerate(texts)]
    out.append((None, base[2], None, None, None, 7, 7, None, 7))
    out.append(out[3])
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
