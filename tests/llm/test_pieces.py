import os
import random

import numpy as np
import pytest

from conftest import SF_SMALL
from parlance.llm import pieces as pc

pytestmark = pytest.mark.skipif(not os.path.exists(pc.MODEL_FILE), reason="no vocabulary file")
PARTS = ["▁", "  ", "\n", "a", "the", "é", "漢字", "😀", "<0x41>", "\t", "▁the", " ", "=", "=" * 16, "x" * 40, " word"]


@pytest.fixture(scope="module")
def vocabulary():
    return pc.load_vocabulary()


def _round_trip(texts, v):
    ids, offsets = pc.encode(texts, v)
    data, ends = pc.decode(ids.astype(np.int64), offsets, v)
    return [data[ends[i]:ends[i + 1]].tobytes().decode() for i in range(len(texts))]


def test_round_trip(vocabulary, monkeypatch):
    rng = random.Random(3)
    for k in range(60):
        if k == 30:
            monkeypatch.setattr(pc, "_PIECE_CHARS", 5)
            monkeypatch.setattr(pc, "text_parts", lambda t: text_parts(t, 5))
        texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 12))) for _ in range(rng.randint(0, 6))]
        assert _round_trip(texts, vocabulary) == texts


text_parts = pc.text_parts


def test_long_run_without_a_cut(vocabulary):
    text = "x" * 20_000 + "=" * 5_000
    assert _round_trip([text], vocabulary) == [text]


def _best(word, score, unknown):
    best, path = [0.0] + [float("-inf")] * len(word), [[]] + [None] * len(word)
    for e in range(1, len(word) + 1):
        for b in range(e):
            s = score.get(word[b:e], unknown if e - b == 1 else None)
            if s is not None and best[b] + s > best[e] + 1e-9:
                best[e], path[e] = best[b] + s, path[b] + [word[b:e]]
    return best[-1]


def test_words_have_the_best_score(vocabulary):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=pc.MODEL_FILE)
    score, name = {}, {}
    for keys, scores in zip(vocabulary.ids, vocabulary.scores):
        for i, s in zip(keys.tolist(), scores.tolist()):
            score[p.id_to_piece(i)], name[i] = s, p.id_to_piece(i)
    rng = random.Random(5)
    words = ["".join(rng.choices("theandionrsxé", k=rng.randint(1, 14))) for _ in range(200)] + ["=" * 40, "x" * 300]
    ids, offsets = pc.encode(words, vocabulary)
    for i, w in enumerate(words):
        mine = [name[x] for x in ids[offsets[i]:offsets[i + 1]].tolist()]
        assert "".join(mine) == "▁" + w
        assert abs(sum(score[x] for x in mine) - _best("▁" + w, score, vocabulary.unknown)) < 1e-4 * len(w)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1, None), (-2, ""), (-2, ""), (-3, "▁ \n")], "doc_id long, text string")
    docs = docs.unionByName(more)
    coded = pc.encode_documents(docs)
    back = pc.decode_documents(coded)
    assert sorted(map(str, back.collect())) == sorted(map(str, docs.collect()))
    rows = pc.token_digests(docs).collect()
    assert len(rows) == docs.count() and all(r["round_trip"] for r in rows)
    ids = {r["doc_id"]: r for r in coded.collect()}
    assert ids[-1]["ids"] is None and ids[-2]["ids"] == [] and all(r["n_tokens"] == ids[r["doc_id"]]["n_tokens"] for r in rows)


def test_texts_without_spaces_are_cut_where_no_piece_crosses(monkeypatch):
    import random
    import tracemalloc
    v = pc.load_vocabulary()
    rng = random.Random(3)
    han = [chr(0x4E00 + rng.randrange(3000)) for _ in range(400)]
    texts = ["".join(rng.choice(han) for _ in range(5000)), "".join(rng.choice("abcdeé") for _ in range(3000)), "ab" * 2000,
             "x" * 700 + " " + "".join(rng.choice(han) for _ in range(900))]
    whole = [a.tolist() for a in pc.encode(texts, pc.load_vocabulary())]
    for t in texts:
        parts = pc.short_parts(" " + t, v, 64)
        assert "".join(parts) == " " + t
    assert max(map(len, pc.short_parts(texts[0], v, 64))) <= 64 + 20
    monkeypatch.setattr(pc, "_PIECE_CHARS", 100)
    monkeypatch.setattr(pc.short_parts, "__defaults__", (100,))
    assert [a.tolist() for a in pc.encode(texts, v)] == whole
    monkeypatch.undo()
    long = "".join(rng.choice(han) for _ in range(50000)) * 60
    tracemalloc.start()
    ids, _ = pc.encode([long], v)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 400e6, most
