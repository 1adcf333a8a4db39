"""Small tables with what operators must bear."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tie long, m long, score double"


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(("an", "er", "Th", "ou", "né", "st", "ing")) for _ in range(rng.randint(1, 4))) for _ in range(n)) + "."


def odd_rows() -> list[tuple]:
    """NULLs, empty and very long texts, copies, near copies, repeated rows and lines, characters of several bytes."""
    rng = random.Random(5)
    base = [prose(rng, 60) for _ in range(6)]
    texts: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, "   \n\t "), (4, "a" * 900), (5, "é" * 300), (6, "ab " * 400), (7, base[0]), (8, base[0]), (8, base[0]), (9, base[0][:150] + " changed " + base[0][160:]), (None, base[1]), (None, None), (10, base[1])]
    texts += [(20 + i, prose(rng, 30) + "\n" + base[2] + "\n" + prose(rng, 20)) for i in range(12)]
    texts += [(40, base[3] + base[3]), (41, prose(rng, 20_000)), (42, "日本語テキスト" * 40), (-7, base[4]), (43, base[4].upper()), (44, "!!! ??? 123 456"), (45, "word")]
    return [(d, t, ("en", "fr", "de", None)[i % 4], None if i % 5 == 0 else "s", len(t or ""), i, i, 0.5) for i, (d, t) in enumerate(texts)]
