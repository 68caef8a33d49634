"""Small inputs with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import random

WORDS = "the of cat dog sun moon red blue tree house river stone and or but not very old new big small".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(40)) if rng.random() < 0.6 else "") for _ in range(n))


def texts(seed: int = 7) -> list:
    rng = random.Random(seed)
    base = [prose(rng, rng.choice([3, 12, 30, 80, 200])) for _ in range(40)]
    out = list(base)
    for text in base[:12]:  # near copies
        words = text.split()
        for _ in range(3):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "changed"
            out.append(" ".join(copy))
    out += base[:6] * 3  # exact copies
    shared = prose(rng, 40)
    out += [f"{prose(rng, 15)}\n{shared}\n{prose(rng, 10)}" for _ in range(12)]  # a common passage
    line = "This very Line stands in many documents."
    out += [f"{prose(rng, 8)}\n  {line.upper()}\t\n{prose(rng, 8)}\n{line}\n{line}" for _ in range(10)]
    out += [None, "", "   \n\t ", "word", "two words", "two words", "a\n\nb\n", "re re " * 60, "x" * 5000, "é" * 30 + " ü ß 漢字"]
    out.append(" ".join(prose(rng, 4000).split()))
    rng.shuffle(out)
    return out


def documents(spark, seed: int = 7):
    rows = [(i, t, ["en", "xx", None][i % 3], "s", 0, "k", 1) for i, t in enumerate(texts(seed))]
    # names that the operators use themselves
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, node int"
    ).repartition(5)
