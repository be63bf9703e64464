"""SentencePiece encoding and decoding by batched Viterbi in numpy.

A vocabulary file gives pieces and scores.  Texts are cut into words (a run
of spaces and what follows); no piece crosses into a run of spaces.  The
distinct words of a batch that no earlier batch has seen are probed: for each
piece length, the hashes of all substrings are looked up among the sorted
hashes of the pieces of that length.  Where no found piece crosses a
position, words are cut further without loss; a text without spaces is cut
so before its table is filled, in stretches of bounded length.  Parts of equal length then
advance together through the Viterbi table; vectorised maxima keep the back
pointers.  Characters without a piece become byte pieces.

Decoding looks the bytes of all pieces up and joins them.

A file made by pair merging has ranks in place of log probabilities.  Their
sum would favour many short pieces, so ranks are read as the log
probabilities of Zipf's law; scores of a unigram file are used as they are.
"""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.arrow import arrow_schema, map_batches, map_rows
from parlance.llm.words import row_slices, string_buffers

MODEL_FILE = os.environ.get("PARLANCE_SENTENCEPIECE", "/opt/tokenizers/piece_bpe_32k.model")
_SPACE = 0x2581
# Stands for a literal U+2581 of the text, which only byte pieces can write.
_LITERAL = 0x110000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_UNKNOWN_COST = 10.0
_PIECE_BYTES = 1 << 20
_PIECE_CHARS = 1 << 19
# Parts longer than this go through the table one by one.
_LONG = 192
_RUN = re.compile("(?<! ) ")
_CACHE_WORDS = 200_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _prefix(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums of code points, and the inverse powers that bring a substring to position 0."""
    n = len(codes)
    power = np.multiply.accumulate(np.full(n + 1, _BASE, np.uint64))
    inverse = np.multiply.accumulate(np.full(n + 1, _INVERSE, np.uint64))
    sums = np.zeros(n + 1, np.uint64)
    values = _mix(codes.astype(np.uint64) + np.uint64(0x51ED270B))
    np.cumsum(values * power[:n], out=sums[1:])
    return sums, inverse


def _hash(sums, inverse, start, end):
    return _mix((sums[end] - sums[start]) * inverse[start])


@dataclass
class Vocabulary:
    """Pieces by length: sorted hashes, scores and ids; bytes of every piece; ids of byte pieces."""

    keys: list[np.ndarray]
    scores: list[np.ndarray]
    ids: list[np.ndarray]
    unknown: float
    bytes_of: np.ndarray
    offset: np.ndarray
    byte_ids: np.ndarray
    _cache: dict = field(default_factory=dict, repr=False)


def load_vocabulary(path: str = MODEL_FILE, zipf: bool | None = None) -> Vocabulary:
    """Read a SentencePiece model file.  ``zipf`` None: ranks are told from log probabilities by the model type."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    plain = [i for i in range(n) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
    if zipf is None:
        # Merge ranks fall by one from piece to piece.
        given = [p.get_score(i) for i in plain]
        steps = [a - b for a, b in zip(given, given[1:])]
        zipf = sum(s == 1 for s in steps) > len(steps) / 2
    if zipf:
        # Log of 1 / (rank + 1), scaled to sum to 1 over the pieces.
        total = np.log((1 / np.arange(1, len(plain) + 1)).sum())
        score = {i: float(-np.log(r + 1) - total) for r, i in enumerate(plain)}
    else:
        score = {i: float(p.get_score(i)) for i in plain}
    byte_ids = np.full(256, -1, np.int32)
    data = [b""] * n
    for i in range(n):
        if p.is_byte(i):
            value = int(p.id_to_piece(i)[3:5], 16)
            byte_ids[value] = i
            data[i] = bytes([value])
    for i in plain:
        data[i] = p.id_to_piece(i).replace(chr(_SPACE), " ").encode()
    if (byte_ids < 0).any():
        raise ValueError("the vocabulary has no byte pieces: texts could not be read back")
    longest = max(len(p.id_to_piece(i)) for i in plain)
    keys, scores, ids = [], [], []
    for size in range(1, longest + 1):
        mine = np.array([i for i in plain if len(p.id_to_piece(i)) == size], np.int32)
        text = "".join(p.id_to_piece(int(i)) for i in mine)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        sums, inverse = _prefix(codes)
        at = np.arange(len(mine)) * size
        h = _hash(sums, inverse, at, at + size)
        order = np.argsort(h)
        keys.append(h[order])
        ids.append(mine[order])
        scores.append(np.array([score[int(i)] for i in mine], np.float32)[order])
    lengths = np.array([len(d) for d in data], np.int64)
    return Vocabulary(keys, scores, ids, float(min(score.values())) - _UNKNOWN_COST,
                      np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum(lengths)]), byte_ids)


def text_parts(text: str, size: int = _PIECE_CHARS) -> list[str]:
    """``text`` behind its leading space, cut where runs of spaces begin into parts of about ``size`` characters."""
    if not text:
        return []
    out, a, t = [], 0, " " + text
    while a < len(t):
        m = _RUN.search(t, a + size) if len(t) - a > size else None
        b = m.start() if m else len(t)
        out.append(t[a:b])
        a = b
    return out


def short_parts(part: str, v: Vocabulary, size: int = _PIECE_CHARS) -> list[str]:
    """``part`` cut into parts of at most ``size`` characters, where no piece crosses: they encode as ``part`` does.

    Only as many characters as are cut next are looked up at a time.  A
    stretch that pieces cross everywhere stays whole.
    """
    out, a, span, reach = [], 0, size, len(v.keys)
    while len(part) - a > size:
        ahead = part[a:a + span + reach]
        codes, _ = _codes([ahead])
        crossed = _crossings(codes, np.arange(len(codes)), np.full(len(codes), len(codes)), v)
        # Pieces over a place up to ``span`` end inside what was looked up.
        free = np.flatnonzero(crossed[1:min(span, len(codes) - 1) + 1] == 0) + 1
        if len(free):
            out.append(part[a:a + int(free[-1])])
            a, span = a + int(free[-1]), size
        elif span >= len(part) - a:
            break
        else:
            span *= 2
    return out + [part[a:]]


def _crossings(codes: np.ndarray, where: np.ndarray, limit: np.ndarray, v: Vocabulary) -> np.ndarray:
    """How many pieces lie over every place between two characters."""
    sums, inverse = _prefix(codes)
    crossed = np.zeros(len(codes) + 1, np.int64)
    for k in range(1, len(v.keys)):
        at = where[where + k + 1 <= limit]
        if not len(at) or not len(v.keys[k]):
            continue
        h = _hash(sums, inverse, at, at + k + 1)
        slot = np.minimum(np.searchsorted(v.keys[k], h), len(v.keys[k]) - 1)
        at = at[v.keys[k][slot] == h]
        crossed += np.bincount(at + 1, minlength=len(crossed)) - np.bincount(at + k + 1, minlength=len(crossed))[:len(crossed)]
    return np.cumsum(crossed)


def _codes(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all parts, spaces as U+2581; start of every part."""
    codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.int64)
    codes[codes == _SPACE] = _LITERAL
    codes[codes == 0x20] = _SPACE
    return codes, np.concatenate([[0], np.cumsum([len(t) for t in parts], dtype=np.int64)]).astype(np.int64)


def _viterbi(codes: np.ndarray, start: np.ndarray, end: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids per word) of the words [start, end) of ``codes``; an id under 0 is -1 - code point."""
    n = len(codes)
    sums, inverse = _prefix(codes)
    limit = np.repeat(end, end - start)
    where = np.concatenate([np.arange(a, b) for a, b in zip(start, end)]) if len(start) else np.zeros(0, np.int64)
    longest = len(v.keys)
    score = np.full((longest, n), -np.inf, np.float32)
    piece = np.full((longest, n), -1, np.int32)
    crossed = np.zeros(n + 1, np.int32)
    for k in range(longest):
        at = where[where + k + 1 <= limit]
        if not len(at) or not len(v.keys[k]):
            continue
        h = _hash(sums, inverse, at, at + k + 1)
        slot = np.minimum(np.searchsorted(v.keys[k], h), len(v.keys[k]) - 1)
        hit = v.keys[k][slot] == h
        at, slot = at[hit], slot[hit]
        score[k, at] = v.scores[k][slot]
        piece[k, at] = v.ids[k][slot]
        if k:
            np.add.at(crossed, at + 1, 1)
            np.add.at(crossed, at + k + 1, -1)
    alone = piece[0, where] < 0
    score[0, where[alone]] = v.unknown
    # A position that no longer piece crosses ends a part.
    cut = np.cumsum(crossed)[:n] == 0
    cut[start] = True
    inside = np.zeros(n, bool)
    inside[where] = True
    head = np.flatnonzero(cut & inside)
    stop = np.concatenate([head[1:], [n]]) if len(head) else head
    word_of = np.searchsorted(start, head, "right") - 1
    stop = np.minimum(stop, end[word_of])
    size = stop - head
    token = np.zeros(n, np.int32)
    takes = np.zeros(n, bool)
    for h, e in zip(head[size > _LONG], stop[size > _LONG]):
        for at, k in _one_by_one(score[:, h:e]):
            token[h + at] = piece[k - 1, h + at] if piece[k - 1, h + at] >= 0 else -1 - codes[h + at]
            takes[h + at] = True
    for m in np.unique(size[size <= _LONG]):
        rows = head[size == m]
        best = np.zeros((len(rows), m + 1))
        back = np.zeros((len(rows), m + 1), np.int8 if longest < 128 else np.int32)
        for e in range(1, m + 1):
            top = np.full(len(rows), -np.inf)
            for k in range(min(e, longest), 0, -1):
                s = best[:, e - k] + score[k - 1, rows + (e - k)]
                better = s > top
                top[better] = s[better]
                back[better, e] = k
            best[:, e] = top
        left = np.full(len(rows), m)
        live = np.arange(len(rows))
        while len(live):
            k = back[live, left[live]].astype(np.int64)
            left[live] -= k
            at = rows[live] + left[live]
            found = piece[k - 1, at]
            token[at] = np.where(found >= 0, found, -1 - codes[at])
            takes[at] = True
            live = live[left[live] > 0]
    count = np.add.reduceat(takes[where].astype(np.int64), np.cumsum(end - start) - (end - start)) if len(start) else np.zeros(0, np.int64)
    return token[where][takes[where]], count


def _one_by_one(score: np.ndarray) -> list[tuple[int, int]]:
    """(place, length) of the pieces of one long part; ``score[k - 1, i]``: of the piece of length k at i."""
    n = score.shape[1]
    at, k = np.nonzero(np.isfinite(score.T))
    gain = score.T[at, k].tolist()
    best, back = [float("-inf")] * (n + 1), [0] * (n + 1)
    best[0] = 0.0
    for i, size, g in zip(at.tolist(), (k + 1).tolist(), gain):
        s = best[i] + g
        if s > best[i + size]:
            best[i + size], back[i + size] = s, size
    out, e = [], n
    while e:
        size = back[e]
        e -= size
        out.append((e, size))
    return out


def _expand(tokens: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Byte pieces in place of tokens under 0; how many ids each token became."""
    width = np.ones(len(tokens), np.int64)
    lost = np.flatnonzero(tokens < 0)
    if not len(lost):
        return tokens, width
    spelled = []
    for i in lost:
        c = -1 - int(tokens[i])
        spelled.append(v.byte_ids[list(chr(_SPACE if c == _LITERAL else c).encode())])
        width[i] = len(spelled[-1])
    out = np.repeat(tokens, width)
    first = np.cumsum(width) - width
    for i, ids in zip(lost, spelled):
        out[first[i]:first[i] + len(ids)] = ids
    return out, width


def encode(texts: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, offsets of the texts)."""
    done, size = [], np.zeros(len(texts), np.int64)
    held: list[tuple[int, str]] = []
    chars = 0
    for i, t in enumerate(texts):
        for part in (x for whole in text_parts(t) for x in (short_parts(whole, v) if len(whole) > 2 * _PIECE_CHARS else [whole])):
            held.append((i, part))
            chars += len(part)
            if chars >= _PIECE_CHARS:
                _encode_held(held, v, done, size)
                held, chars = [], 0
    _encode_held(held, v, done, size)
    return (np.concatenate(done) if done else np.zeros(0, np.int32)), np.concatenate([[0], np.cumsum(size)])


def _encode_held(held: list[tuple[int, str]], v: Vocabulary, done: list, size: np.ndarray) -> None:
    if held:
        ids, offsets = _encode_parts([p for _, p in held], v)
        done.append(ids)
        np.add.at(size, [i for i, _ in held], np.diff(offsets))


def _encode_parts(parts: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    codes, offsets = _codes(parts)
    n = len(codes)
    space = codes == _SPACE
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    begin[offsets[:-1][np.diff(offsets) > 0]] = True
    start = np.flatnonzero(begin)
    end = np.concatenate([start[1:], [n]])
    sums, inverse = _prefix(codes)
    h = _hash(sums, inverse, start, end) ^ _mix((end - start).astype(np.uint64))
    distinct, sample, use = np.unique(h, return_index=True, return_inverse=True)
    cache = v._cache
    known = cache.get("keys", np.zeros(0, np.uint64))
    slot = np.minimum(np.searchsorted(known, distinct), max(len(known) - 1, 0))
    old = known[slot] == distinct if len(known) else np.zeros(len(distinct), bool)
    fresh = np.flatnonzero(~old)
    a, b = start[sample[fresh]], end[sample[fresh]]
    size = b - a
    own = np.cumsum(size) - size
    flat = codes[np.repeat(a - own, size) + np.arange(int(size.sum()))]
    tokens, count = _viterbi(flat, own, own + size, v)
    tokens, width = _expand(tokens, v)
    total = np.add.reduceat(width, np.cumsum(count) - count) if len(count) else count
    # One table of the words of this batch: earlier ones from the cache, then the fresh ones.
    at = np.zeros(len(distinct), np.int64)
    length = np.zeros(len(distinct), np.int64)
    pool = cache.get("pool", np.zeros(0, np.int32))
    at[old], length[old] = (cache["at"][slot[old]], cache["length"][slot[old]]) if len(known) else (0, 0)
    at[fresh], length[fresh] = len(pool) + np.cumsum(total) - total, total
    pool = np.concatenate([pool, tokens])
    _remember(cache, known, distinct[fresh], at[fresh], total, pool)
    each, word = length[use], at[use]
    first = np.cumsum(each) - each
    ids = pool[np.repeat(word - first, each) + np.arange(int(each.sum()))]
    ends = np.concatenate([first, [int(each.sum())]])
    return ids, ends[np.searchsorted(start, offsets)]


def _remember(cache: dict, known, fresh, at, length, pool) -> None:
    """Keep the words seen, unless they have become too many: then start afresh."""
    if len(known) + len(fresh) > _CACHE_WORDS:
        cache.clear()
        return
    keys = np.concatenate([known, fresh])
    order = np.argsort(keys, kind="stable")
    cache["at"] = np.concatenate([cache.get("at", np.zeros(0, np.int64)), at])[order]
    cache["length"] = np.concatenate([cache.get("length", np.zeros(0, np.int64)), length])[order]
    cache["keys"], cache["pool"] = keys[order], pool


def decode(ids: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of the texts), without the leading space of each."""
    size = v.offset[ids + 1] - v.offset[ids]
    first = np.cumsum(size) - size
    total = int(size.sum())
    data = v.bytes_of[np.repeat(v.offset[ids] - first, size) + np.arange(total)]
    ends = np.concatenate([first, [total]])[offsets]
    keep = np.ones(total, bool)
    keep[ends[:-1][np.diff(ends) > 0]] = False
    return data[keep], ends - np.concatenate([[0], np.cumsum(np.diff(ends) > 0)])


def encode_documents(docs: DataFrame, path: str = MODEL_FILE) -> DataFrame:
    """doc_id, n_tokens, ids of every row of ``docs`` (doc_id, text).

    Ids are those of the best sequence of pieces.  A file made by pair
    merging has its own encoder replay the merges, which gives other pieces
    for about a third of distinct words: ids from here fit models that are
    trained on ids from here, not a model trained with that encoder.

    A null text has null ids and 0 tokens, an empty one no ids.  The vocabulary is read by
    the driver and sent to the executors.  Equal rows get equal results; an
    empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ddl = "doc_id long, n_tokens long, ids array<int>"
    schema = arrow_schema(ddl)

    def rows(batches):
        for batch in batches:
            for part in row_slices(batch, "text", _PIECE_BYTES):
                texts = part.column(1)
                ids, offsets = encode([t or "" for t in texts.to_pylist()], held.value)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()),
                                                 type=schema.field("ids").type, mask=texts.is_null())
                yield pa.record_batch([part.column(0), pa.array(np.diff(offsets)), lists], schema=schema)
    return map_batches(narrow, rows, ddl)


def decode_documents(encoded: DataFrame, path: str = MODEL_FILE) -> DataFrame:
    """doc_id, text of every row of ``encoded`` (doc_id, ids); null ids give a null text."""
    held = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def rows(batches):
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not ids.is_valid:
                    yield doc, None
                    continue
                x = ids.values.to_numpy(zero_copy_only=False).astype(np.int64)
                data, _ = decode(x, np.array([0, len(x)]), held.value)
                yield doc, data.tobytes().decode("utf-8")
    return map_rows(encoded.select("doc_id", "ids"), rows, "doc_id long, text string")


def _digest_rows(batches, v: Vocabulary):
    for batch in batches:
        for part in row_slices(batch, "text", _PIECE_BYTES):
            col = part.column(1)
            texts = col.to_pylist()
            ids, offsets = encode([t or "" for t in texts], v)
            data, ends = decode(ids.astype(np.int64), offsets, v)
            want, edges = string_buffers(col)
            same = np.array_equal(data, want) and np.array_equal(ends, edges)
            for i, doc in enumerate(part.column(0).to_pylist()):
                mine = ids[offsets[i]:offsets[i + 1]]
                exact = same or data[ends[i]:ends[i + 1]].tobytes() == want[edges[i]:edges[i + 1]].tobytes()
                yield doc, len(mine), hashlib.sha256(mine.astype("<i4").tobytes()).hexdigest(), bool(exact)


def token_digests(docs: DataFrame, path: str = MODEL_FILE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers), round_trip (decoded text equals the text).

    A null, empty or unencodable text: null and empty texts have 0 tokens and
    the digest of no bytes, and read back as the empty text; every character
    can be written by byte pieces, so no text is left out.  Equal and repeated
    rows get equal results, each its own; of equally good sequences the one
    with the longer last piece counts.  Other columns are ignored; an empty
    table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(narrow, lambda it: _digest_rows(it, held.value),
                    "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean")
