"""Awkward documents."""


def long_text(words=30_000):
    return " ".join(f"w{i * 7919 % 10007}" for i in range(words))


#: Every awkward document at once.
AWKWARD = [
    (1, None, "en", "src1", 0), (2, "", "en", "src1", 0), (3, " \n\t ", None, None, None), (4, "one", "en", None, 3), (5, long_text(), "en", "src0", 9),
    (6, "the same words again and again here", "en", "src1", 5), (7, "the same words again and again here", "en", "src1", 5),
    (7, "the same words again and again here", "en", "src1", 5), (None, "a row without an id", "en", "src1", 5), (8, "x" * 50_000, "de", "src2", 1),
    (9, "12 34 !?", "zz", "src3", 8), (10, "　é😀 ñ \x85 end", "es", "", 3),
]
