"""Helpers of the corpus tests."""

import random

WORDS = "the of alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) + ("\n" if rng.random() < 0.05 else "") for _ in range(n))


def by_id(df, *columns):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0, *[r[c] for c in columns]) for r in df.collect()), key=repr)
