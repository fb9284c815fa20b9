"""Rows and texts that the tests of the corpus operators share."""

import random

#: Rows that every operator must stand: nulls in each column, empty and blank texts, repeated rows, extra columns.
ODD = [
    (1, "A plain text of a few words that says nothing much at all, and one more line.\nSecond line", "en", "s", 0, "x"),
    (2, None, "en", "s", None, None), (3, "", None, None, 0, "x"), (4, " \t\n\n \x0b", "en", "s", 4, "x"),
    (None, "no id here, but a text of some words", "en", "s", 5, "x"),
    (6, "same row twice\nsame row twice", "en", "s", 5, "x"), (6, "same row twice\nsame row twice", "en", "s", 5, "x"),
    (7, "one id, first text", "de", "t", 5, "x"), (7, "one id, second text", "de", "t", 5, "x"),
    (8, "Äé ß \U0001f600 ‘quote’ İstanbul KELVIN K", "de", "t", 5, "x"),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_lines string"


def long_text(seed=1, words=60_000):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9)))
                    + rng.choice(["", "", "", ".\n", ","]) for _ in range(words))
