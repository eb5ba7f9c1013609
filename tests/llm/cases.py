"""Small documents with every awkward case, and plain versions of what operators compute."""

import random
import re
import string

from barloom.llm._store import Scratch

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: columns with names that operators use themselves
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, score double, path string, n int"


def row(i, text, source="s"):
    return (i, text, "en", source, len(text) if text is not None else None, 1, 0.5, "p", 2)


def documents(spark, extra=()):
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    base = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(30, 90))) for _ in range(25)]
    texts = [*base, *base[:6]]
    for b in base[:10]:  # near copies of several degrees
        words = b.split(" ")
        for k in (1, 3, 6, 12):
            w = list(words)
            for _ in range(k):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            texts.append(" ".join(w))
    texts += [
        "",
        " \n\t ",
        "One",
        "one",
        "ONE two three four",
        "one two three four",
        "a b c d e",
        "a b c d e f",
        "é ñ ß 中文 🙂   x",
        "tab\tand\x0bvertical\x0cfeed",
        "word " * 30_000,
        "  double  spaces  ",
        "Ends with space ",
        "<|endoftext|> <|startoftext|>x",
    ]
    rows = [row(10 + 3 * i, t) for i, t in enumerate(texts)]
    rows += [row(5, None), row(None, base[0]), row(None, None), rows[2], rows[2], *extra]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def scratch(spark):
    return Scratch(spark, "test")


def shingle_set(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def linked(x, y):
    both = len(x & y)
    return bool(x) and bool(y) and 100 * both >= 80 * (len(x) + len(y) - both)


def groups(sets):
    """Smallest id of each id's group; sets by id."""
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, i in enumerate(ids):
        for j in ids[:a]:
            if find(i) != find(j) and linked(sets[i], sets[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in ids}
