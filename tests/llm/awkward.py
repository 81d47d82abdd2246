#: Nulls in each column, empty text, ties, repeated rows, white space alone, a long text, characters outside the BMP.
AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog", "a"), (2, "the QUICK brown fox jumps over the lazy dog", "a"), (3, None, "a"), (4, "", None),
    (4, "", None), (None, "no id here", "b"), (None, None, None), (5, " \t\n\x0b\x0c\r ", "b"), (6, "x" * 30000, "c"), (7, "word " * 9000, "a"),
    (8, "ÀÉÎ İstanbul ΑΣ. \U0001f600 it's 42% <|endoftext|>", "\U0001f600"), (9, "one", "b"), (9, "one", "b"), (9, "two words", "b"), (10, "The quick brown fox jumps over the lazy cat", "a"),
]
