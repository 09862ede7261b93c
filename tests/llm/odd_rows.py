"""Rows that every operator must take."""

#: Nulls in any column, empty and blank texts, repeated rows, ties.
ODD = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (4, " \t\n "), (None, "a b c d e f g"), (5, "x"), (6, "Ünï çödé ▁ text"), (None, None), (7, "a b c d e f")]
