"""Random texts for tests."""

import random


def words(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


VOCABULARY = ["".join(random.Random(i).choice("abcdefghijklmnopqrstuvwxyzéü") for _ in range(3 + i % 5)) for i in range(400)]
