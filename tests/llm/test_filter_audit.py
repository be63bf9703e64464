import random
import re
from collections import Counter
from itertools import permutations

import numpy as np

from helpers import DOCS, WORD, documents
from parlance.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int"


def _rows(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = documents(seed)
    more = []
    for i in range(60):
        words = [rng.choice(["Aa", "bb", "CCC", "d$", "é", "x|"]) if rng.random() < 0.5 else f"v{rng.randrange(300)}" for _ in range(rng.randrange(0, 120))]
        more.append((5000 + i, " ".join(words[:3]) + " ".join(words[3:]), "en", rng.choice(["", "a", "é", None]), 0))
    return rows + more + more[:4] + [(None, more[0][1], None, "a", None), (None, None, None, None, None), (-3, more[1][1], "en", "z", 1)]


def _failed(rows) -> list[str]:
    """The letters of the filters that each row fails."""
    least: dict[str, int] = {}
    for doc, text, *_ in rows:
        if doc is not None:
            least[text or ""] = min(least.get(text or "", doc), doc)
    out = []
    for doc, text, *_ in rows:
        t = text or ""
        w = WORD.findall(t)
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
               "D": bool(re.search(r"[#$%&*|]", t)), "E": doc is not None and least[t] < doc}
        out.append("".join(k for k in "ABCDE" if bad[k]))
    return out


def _audit(rows, labels) -> Counter:
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    got: Counter = Counter()
    for row, bad in zip(rows, _failed(rows)):
        part = row[3] or ""
        for order in map("".join, permutations("ABCDE")):
            first = next((i for i, f in enumerate(order) if f in bad), 9)
            for k, f in enumerate(order):
                got[part, order, k + 1, "kept"] += first > k
                got[part, order, k + 1, "removed"] += first == k
                got[part, order, k + 1, "redundant"] += f in bad and first < k
                got[part, order, k + 1, "unique_fails"] += bad == f
                got[part, order, k + 1, "good_lost"] += first == k and row[0] in good
                got[part, order, k + 1, "toxic_lost"] += first == k and row[0] in toxic
                got[part, f, "shapley"] += first == k
    return got


def test_every_order_against_the_documents(spark):
    rows = _rows(3)
    rng = random.Random(4)
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1, None])) for r in rows if rng.random() < 0.6] + [(None, 1, 1), (10 ** 9, 1, 1)]
    want = _audit(rows, labels)
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    got = filter_audit.filter_audit(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 600 * len({r[3] or "" for r in rows})
    for g in got:
        for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
            assert g[c] == want[g["part"], g["filter_order"], g["step"], c], (g, c)
        assert g["shapley"] == want[g["part"], g["filter_order"][g["step"] - 1], "shapley"]


def test_words_say_which_subsets_a_document_survives(spark):
    rows = _rows(9)
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([], LABELS)
    got = Counter((r["doc_id"], r["word"]) for r in filter_audit.survival_words(docs, labels).collect())
    want = Counter()
    for row, bad in zip(rows, _failed(rows)):
        word = sum(1 << s for s in range(32) if not any(s >> i & 1 and f in bad for i, f in enumerate("ABCDE")))
        want[row[0], word] += 1
    assert got == want


def test_positional_counts():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 7, 64, 1000, 4097):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        assert filter_audit.positional_counts(words).tolist() == [int((words >> np.uint32(i) & 1).sum()) for i in range(32)]


def test_long_text_counts_its_words_in_pieces(monkeypatch):
    rng = random.Random(1)
    raw = " \n".join(f"w{rng.randrange(200)}" for _ in range(5000)).encode()
    whole = filter_audit._word_counts(raw)
    monkeypatch.setattr(filter_audit, "_WHOLE_TEXT", 512)
    assert filter_audit._word_counts(raw) == whole == (5000, 200)


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame(documents(2), DOCS)
    for c in ("part", "digest", "fails", "leads", "good", "toxic", "word", "label", "n", "s", "f", "step", "_id", "quality"):
        docs = docs.withColumn(c, docs["lang"])
    labels = spark.createDataFrame([(1, 1, 0)], LABELS).selectExpr("*", "'x' text", "'y' source", "1 word", "2 part")
    assert filter_audit.filter_audit(docs, labels).count() == 600 * 4
    assert filter_audit.filter_audit(docs.limit(0), labels).collect() == []
    assert filter_audit.filter_audit(docs, labels.limit(0)).filter("good_lost > 0").count() == 0
