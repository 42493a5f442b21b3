"""Small made-up documents for tests."""

import random
import zlib

ODD = [(None, "text of no id with quite some words in it to be kept or not"), (900, None), (901, ""), (902, " \n\t\n"), (903, "x" * 200_000), (904, "ten words are here and so it goes on and on"), (904, "ten words are here and so it goes on and on"), (905, "1234 5678 !!! ###")]
#: Columns named like those that operators use inside.
CLASHING = "doc_id long, text string, id int, label int, host string, lines string, score double, start int, spans string, n_words int, source string"


def clashing(rows):
    return [(i, t, 1, 1, "h", "l", 0.5, 3, "s", 9, "src") for i, t in rows]


def prose(rng, words=60, syllables=("an", "the", "er", "ing", "ou", "st", "re", "ly", "on")):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(words)).capitalize() + "."


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def labelled_corpus(n=480, seed=3):
    """(documents, labels): good prose, and junk in capitals, of symbols or of repeats."""
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        text = prose(rng, rng.randint(30, 90))
        if k % 3 == 0:
            kind = k // 3 % 3
            text = [text.upper().replace(" ", "!! "), text.replace(" ", "### "), " ".join(w for w in text.split()[:6] for _ in range(12))][kind]
        docs.append((k, text))
        labels.append((k, int(k % 3 != 0)))
    return docs, labels
