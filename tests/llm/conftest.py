"""Fixtures of the corpus operators: small documents with the awkward cases."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """rows: (doc_id, text) or (doc_id, text, source)"""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def words():
    rnd = random.Random(5)
    return ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 8))) for _ in range(400)]


@pytest.fixture(scope="session")
def corpus(words):
    """Copies, near copies, shared passages, junk, white space of all kinds, nulls, long texts."""
    rnd = random.Random(6)
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage = text(70)
    rows = [(i, text(rnd.randrange(0, 160))) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    for i in range(8):
        w = rows[i + 10][1].split(" ")
        if w:
            w[len(w) // 2] = "EDIT"
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, text(30) + " " + passage + "\n" + text(i)) for i in range(6)]
    rows += [(400, None), (401, ""), (402, " \t\n\x0b\x0c\r "), (403, "x"), (404, "é 漢字 🙂  a\tb\r\nc"), (405, "a" * 3000), (406, "ab " * 1500), (407, text(4000))]
    rows += [(300, rows[53][1]), (300, rows[53][1])]
    return rows
