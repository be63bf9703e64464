"""Small inputs and brute-force versions shared by the tests."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def word_text(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng: random.Random, text: str, edits: int) -> str:
    w = text.split(" ")
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
    return " ".join(w)


def documents(seed: int = 1) -> list[tuple]:
    """Rows with copies, near copies, a shared passage, nulls, blanks, ties and repeated rows."""
    rng = random.Random(seed)
    texts: list[str | None] = [None, "", " \n\t ", "one", "one two", "ONE two", "a b c d e", "A B C D E"]
    passage = word_text(rng, 40)
    for _ in range(12):
        base = word_text(rng, rng.randint(30, 90))
        texts += [base, base.upper(), edited(rng, base, 1), edited(rng, base, 2), edited(rng, base, 6)]
        texts.append(passage + " " + word_text(rng, 30))
    big = word_text(rng, 120)
    texts += [edited(rng, big, rng.randint(0, 5)) for _ in range(60)]
    rng.shuffle(texts)
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", "c", None]), len(t or ""))
            for i, t in enumerate(texts)]
    return rows + rows[:3]


def shingle_set(text: str | None) -> frozenset:
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(zip(*[w[i:] for i in range(5)]))


def components(ids: list, linked) -> list:
    """Smallest id reachable by ``linked(i, j)`` for every row."""
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                parent[root(i)] = root(j)
    least: dict = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return [least[root(i)] for i in range(len(ids))]
