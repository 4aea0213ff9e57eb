"""Texts for the tests."""

import random

#: Names that operators use inside; tables may have columns of these names too.
CLASHING = ("row", "part", "kind", "d", "h", "score", "leaks", "removed_lines", "fp", "blob", "lower", "known", "size")


def prose(seed: int, words: int, start: str = "") -> str:
    pick = random.Random(seed)
    syllables = ["er", "on", "the", "ing", "sh", "and", "re", "ti", "ha", "ed", "ou", "wh", "é", "ß", "x"]
    made = ["".join(pick.choice(syllables) for _ in range(pick.randint(1, 4))) for _ in range(words)]
    lines = [" ".join(made[i : i + 12]) for i in range(0, len(made), 12)]
    return start + "\n".join(lines)
