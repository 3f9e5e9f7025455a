"""Made texts and the smallest tables."""

from __future__ import annotations

import random

SF = "/root/testdata/sf0.001"


def words(rng: random.Random, n: int, stock: str = "alpha beta gamma delta river stone cloud green walk under table seven light found place") -> str:
    w = stock.split()
    return " ".join(rng.choice(w) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))
