"""Rows that operators must take without harm."""

from __future__ import annotations


def _line(seed: int, n: int) -> str:
    words = "the of and to river stone light over under quick brown fox jumps lazy dog while many small birds sing".split()
    x, out = seed, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(words[(x >> 8) % len(words)] + str((x >> 16) % 7))
    return " ".join(out)


#: Nulls, blanks, ties, repeated rows, near copies, odd scripts, a text without letters and a very long one.
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n\x0b"), (4, "one"), (5, "one"), (6, "One"), (7, "two words"), (8, "12345 !!! ---"),
    (9, _line(1, 60)), (10, _line(1, 60)), (11, _line(1, 60) + " extra"), (12, _line(1, 60).replace(" ", "  ")), (12, _line(1, 60).replace(" ", "  ")),
    (13, _line(2, 30) + "\n" + _line(3, 40)), (14, _line(4, 10) + "\n" + _line(3, 40) + "\n" + _line(5, 25)),
    (15, "日本語のテキスト é É ΟΔΟΣ İ ́ <|endoftext|> don't"), (16, _line(6, 20_000)), (17, "x" * 40_000), (None, _line(7, 50)), (-3, _line(8, 50)),
]
