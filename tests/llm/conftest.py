from __future__ import annotations

import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, size string, score double, kept string, `__key` int"


def words(text):
    return WORD.findall(text or "")


def thue_morse(n, a="a", b="b"):
    """The first n letters of the Thue-Morse word; with its complement it collides under any power sum modulo 2**64."""
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


#: Words that only differ by a complement, alone, in pairs and as words of a window.
ADVERSE = [
    *(thue_morse(n, *x) for n in (128, 1024, 4096) for x in ("ab", "ba")), *(f"{thue_morse(n)} {thue_morse(n, 'b', 'a')} x" for n in (1024, 4096)),
    *(" ".join(thue_morse(2048, *x)) for x in ("ab", "ba")), *(f"{thue_morse(1024, *x)} " * 60 for x in ("ab", "ba")),
]


def make_texts(seed=5, n=60):
    """Invented texts with copies, near-copies, shared passages, repeated words, odd spaces, nulls and empties."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéüß") for _ in range(rng.randrange(1, 7))) for _ in range(400)]
    line = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = line(70)
    texts = [line(rng.randrange(1, 260)) for _ in range(n)]
    base = line(180).split()
    for _ in range(12):
        copy = list(base)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += [texts[0]] * 4 + [f"{line(20)} {passage} {line(15)}" for _ in range(6)] + [passage, "x " * 130, "a b " * 90, "x " * 65 + line(30), line(30) + " x" * 64]
    texts += [None, "", "   ", "one", "One", "two words", "two words", "A b C d", "a B c D", "tab\tand\nline\r\nfeed", "non breaking space  double", line(4000)]
    rng.shuffle(texts)
    return texts


@pytest.fixture(scope="session")
def rows():
    """Rows of a documents table with extra columns of clashing names, a repeated row and rows without an id."""
    sources = ["b", "a", None, "c", "hot", "hot", "hot"]
    out = [(i * 3, t, "en", sources[i % 7], len(t or ""), 7, "s", 0.5, "k", 1) for i, t in enumerate(make_texts())]
    return [*out, out[5], (None, out[0][1], "en", "a", 1, 7, "s", 0.5, "k", 1)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
