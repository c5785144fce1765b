"""Small inputs with the awkward cases that every operator has to stand."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, spans string, kept string, size int"


def passage(rng: random.Random, n: int, words: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def documents(spark, texts, source=None, ids=None):
    """A table of documents with columns that clash with names the operators use."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", source(i) if source else f"s{i % 3 if i is not None else 0}", len(t) if t is not None else None, 0.5, "k", "x", "y", 1) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(seed: int = 1) -> list:
    """Nulls, empty and blank texts, copies, near copies, shared passages, repetition inside a text, one long text."""
    rng = random.Random(seed)
    shared = passage(rng, 90)
    texts = [None, "", " \n\t ", "one", "two words", passage(rng, 30), shared]
    texts += [passage(rng, 200) for _ in range(5)]
    texts += [texts[-1], texts[-1], texts[-2]]
    texts += [f"{passage(rng, 20 + i)} {shared} {passage(rng, 40)}" for i in range(6)]
    texts += [f"{shared}\n{shared}", "aé" * 900, "na " * 300, "ü" * 450 + passage(rng, 60)]
    near = passage(rng, 300).split()
    for i in range(6):
        near = near[:]
        near[50 * i] = f"x{i}"
        texts.append("  ".join(near))
    texts.append(passage(rng, 12_000) + " " + shared)
    return texts
