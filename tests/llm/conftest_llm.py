"""Texts for the corpus tests."""


def prose(seed, words):
    """Invented words, the same for the same seed."""
    state, out = seed * 7919 + 17, []
    for _ in range(words):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append("".join("aeioubdfglmnprst"[(state >> s) % 16] for s in (5, 9, 13, 17, 21)))
    return " ".join(out)


LONG = prose(5, 20_000)
EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (6, "two words"), (None, "two words"), (None, None),
         (7, prose(1, 80)), (7, prose(1, 80)), (8, prose(1, 80)), (9, LONG), (10, LONG + " more"), (11, "ü" * 300), (12, "a\x00b \x1f c")]
