import random
import re

from helpers import DOCS, documents, word_text
from parlance.llm import decontaminate

ITEMS = "item_id long, text string"
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _words(text):
    return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _expected(rows, items, width=10):
    out = []
    for doc, text, *_ in rows:
        w = _words(text)
        hit, named = set(), set()
        for item, t in items:
            b = _words(t)
            n = min(width, len(b))
            if not n or item is None:
                continue
            windows = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)}
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in windows:
                    hit |= set(range(p, p + n))
                    named.add(str(item))
        out.append((doc, len(w), len(hit), tuple(sorted(named))))
    return sorted(out, key=repr)


def _case(seed):
    rng = random.Random(seed)
    rows = documents(seed)
    items = [(i, word_text(rng, rng.choice([1, 2, 4, 9, 10, 11, 30, 60]), 12)) for i in range(25)]
    items += [(100 + i, rows[rng.randrange(len(rows))][1]) for i in range(25)]
    items += [(7, "Über-Größe 12 x"), (8, None), (9, ""), (None, rows[20][1]), (10, "!!"), (11, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1"),
              (12, items[3][1]), (13, "a " * 9 + "b"), (13, "ü w2 " * 12)]
    more = []
    for i in range(60):
        piece = rng.choice(items)[1] or ""
        cut = " ".join(piece.split()[rng.randrange(3):])
        more.append((1000 + i, f"{word_text(rng, rng.randrange(12), 12)},{cut.upper()}... {word_text(rng, rng.randrange(12), 12)}", "en", "a", 1))
    more += [(2000, "w1 " * 30, None, None, 0), (2001, "über-grÖße 12 X y über größe 12", "de", "a", 0), (None, "a " * 9 + "b", "en", "a", 1)]
    return rows + more + more[:3], items


def test_hits_against_all_windows(spark):
    rows, items = _case(1)
    got = decontaminate.decontaminated(spark.createDataFrame(rows, DOCS).repartition(5), spark.createDataFrame(items, ITEMS))
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got.collect()), key=repr)
    assert got == _expected(rows, items)


def test_other_widths_and_the_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(decontaminate, "MOST_BITS", 3)
    monkeypatch.setattr(decontaminate, "LEAST_BITS", 3)
    monkeypatch.setattr(decontaminate, "_bit_table", lambda tokens, n: __import__("numpy").full(1, 255, "uint8"))
    rows, items = _case(3)
    got = decontaminate.decontaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS), width=6, shingle=2)
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got.collect()), key=repr)
    assert got == _expected(rows, items, 6)


def test_long_words_are_never_carried(spark):
    long = "z" * 5000
    rows = [(1, f"a b c {long} d e f g h i j k l m n", "en", "a", 1)]
    items = [(1, "d e f g h i j k l m"), (2, "c d e")]
    got = decontaminate.decontaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert [(r["n_hit"], r["items"]) for r in got] == [(10, ["1"])]


def test_empty_tables_and_clashing_columns(spark):
    rows, items = _case(4)
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)
    plain = sorted(map(tuple, decontaminate.contamination(docs, bench).collect()), key=repr)
    for c in ("row", "token", "window", "place", "before", "context", "n", "shift", "window_id", "n_words", "item_id", "often", "first"):
        docs, bench = docs.withColumn(c, docs["lang"]), bench.withColumn(c, bench["item_id"] if c == "item_id" else bench["text"])
    assert sorted(map(tuple, decontaminate.contamination(docs, bench).collect()), key=repr) == plain
    assert decontaminate.contamination(docs.limit(0), bench).collect() == []
    none = decontaminate.contamination(docs, bench.limit(0)).collect()
    assert len(none) == len(rows) and not any(r["n_hit"] or r["n_items"] or r["contaminated"] for r in none)
