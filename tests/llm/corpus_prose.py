"""Made-up prose for the tests of the corpus operators."""

from __future__ import annotations

import random


def prose(rng: random.Random, n: int) -> str:
    parts = ["on", "the", "re", "tion", "an", "ing", "st", "er", "é", "ou", "in"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))
