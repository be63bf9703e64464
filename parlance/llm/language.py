"""Language identification of mixed text: scripts, word scores, Viterbi spans.

Training counts hashed letter trigrams and words per language over a bounded
sample of labelled texts, and the share of each script among its letters.
Prediction splits a text into words (runs of letters of one script; marks go
with the letter they follow and are no letters themselves), scores
each word for the languages that write its script, and finds the best
sequence of languages under a penalty for every switch.  The text's language
is the one with most letters.

Long texts are cut into chunks of words that all advance together: for every
language before the chunk, the best path through it is kept, and the chunks
of a text are then chained.  The result is the exact best path.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.arrow import map_batches, map_rows
from parlance.llm.words import row_slices

UNDETERMINED = "und"
# Documents per language that training reads, by hash of the id; more add little to letter statistics.
SAMPLE_PER_LANGUAGE = 3000
MOST_LANGUAGES = 1000
BUCKETS = 1 << 15
SWITCH_PENALTY = 14.0
MIN_SCRIPT_SHARE = 0.01
SMOOTHING = 0.5
CHUNK = 128
_PIECE = 1 << 20
_FORBIDDEN = -1e6
_TABLE = 0x20000

# First and last code point of the ranges that tell scripts apart.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}
N_SCRIPTS = len(SCRIPTS) + 1

_tables: dict[str, np.ndarray] = {}


def _code_tables() -> dict[str, np.ndarray]:
    """Per code point: letter, mark, lower case, script (0: any other); besides, canonical pairs and what they compose to."""
    if not _tables:
        chars = [chr(i) for i in range(_TABLE)]
        kinds = [unicodedata.category(c)[0] for c in chars]
        letter = np.array([k == "L" for k in kinds])
        low = np.arange(_TABLE, dtype=np.uint32)
        pairs = {}
        for i, c in enumerate(chars):
            if kinds[i] == "L":
                if len(c.lower()) == 1:
                    low[i] = ord(c.lower())
                apart = unicodedata.decomposition(c).split()
                if len(apart) == 2 and apart[0][0] != "<":
                    first, second = (int(x, 16) for x in apart)
                    if unicodedata.normalize("NFC", chr(first) + chr(second)) == c:
                        pairs[first << 21 | second] = i
        script = np.zeros(_TABLE, np.uint8)
        for k, ranges in enumerate(SCRIPTS.values(), 1):
            for a, b in ranges:
                script[a:min(b + 1, _TABLE)] = k
        keys = np.array(sorted(pairs), np.int64)
        _tables.update(letter=letter, mark=np.array([k == "M" for k in kinds]), lower=low, script=script,
                       pairs=keys, composed=np.array([pairs[k] for k in keys.tolist()], np.uint32))
    return _tables


@dataclass
class Words:
    """The words of a batch: text number, start and end (code points in the text), letters, buckets, script."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    trigrams: np.ndarray
    first: np.ndarray
    word: np.ndarray
    n_texts: int


def _with_marks(codes: np.ndarray, low: np.ndarray, letter: np.ndarray, script: np.ndarray, offsets: np.ndarray):
    """(part of a word, read as part of the character before): marks go with the letter they follow.

    Changes ``script`` of these marks to their letter's, and ``low`` of a
    letter to the lower case of what it and its marks compose to, so that a
    text reads the same composed and decomposed.
    """
    t = _code_tables()
    mark = t["mark"][np.minimum(codes, _TABLE - 1)] & (codes < _TABLE)
    joined = np.zeros(len(codes), bool)
    if not mark.any():
        return letter, joined
    at = np.flatnonzero(mark)
    base = np.maximum.accumulate(np.where(mark, -1, np.arange(len(codes))))[at]
    own = base >= offsets[np.searchsorted(offsets, at, "right") - 1]
    own[own] = letter[base[own]]
    at, base = at[own], base[own]
    script[at] = script[base]
    word = letter.copy()
    word[at] = True
    # The marks of a letter compose one after another, as far as each pair has a character.
    now = codes.copy()
    step = 1
    while len(at):
        use = at - base == step
        key = now[base[use]].astype(np.int64) << 21 | codes[at[use]]
        place = np.minimum(np.searchsorted(t["pairs"], key), len(t["pairs"]) - 1)
        fits = t["pairs"][place] == key
        letters = base[use][fits]
        now[letters] = t["composed"][place[fits]]
        low[letters] = t["lower"][now[letters]]
        joined[at[use][fits]] = True
        going = np.isin(base, letters) & (at - base > step)
        at, base, step = at[going], base[going], step + 1
    return word, joined


def words_of(texts: list[str]) -> Words:
    tables = _code_tables()
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    inside = np.minimum(codes, _TABLE - 1)
    rare = codes >= _TABLE
    letter = (tables["letter"][inside] & ~rare) | (rare & (codes < 0x40000))
    script = tables["script"][inside]
    script[rare] = list(SCRIPTS).index("han") + 1
    low = np.where(rare, codes, tables["lower"][inside])
    part, joined = _with_marks(codes, low, letter, script, offsets)
    before = np.zeros(len(codes), bool)
    if len(codes):
        before[1:] = part[:-1] & (script[:-1] == script[1:])
        edge = offsets[:-1][sizes > 0]
        before[edge] = False
    head = np.flatnonzero(part & ~before)
    follows = np.zeros(len(codes), bool)
    follows[:-1] = before[1:] & part[1:]
    tail = np.flatnonzero(part & ~follows) + 1
    count = lambda x: np.concatenate([[0], np.cumsum(x)])
    letters, read = count(letter), count(part & ~joined)
    letters = letters[tail] - letters[head]
    at = np.flatnonzero(part & ~joined)
    length = read[tail] - read[head]
    total = int(length.sum())
    first = np.cumsum(length) - length
    c = low[at].astype(np.uint64)
    left = np.zeros(total, np.uint64)
    left[1:] = c[:-1]
    left[first] = 0
    right = np.zeros(total, np.uint64)
    right[:-1] = c[1:]
    right[first + length - 1] = 0
    tri = (left * np.uint64(0x9E3779B97F4A7C15) + c * np.uint64(0xC2B2AE3D27D4EB4F) + right * np.uint64(0x165667B19E3779F9))
    tri = ((tri ^ (tri >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % BUCKETS
    place = np.arange(total) - np.repeat(first, length)
    power = np.multiply.accumulate(np.full(int(length.max()) if len(length) else 1, 0xD6E8FEB86659FD93, np.uint64))
    whole = np.add.reduceat((c + np.uint64(1)) * power[place], first) if total else np.zeros(0, np.uint64)
    whole = ((whole ^ (whole >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(40)).astype(np.int64) % BUCKETS
    text = np.searchsorted(offsets, head, "right") - 1
    return Words(text, head - offsets[text], tail - offsets[text], letters, script[head], tri, first, whole, len(texts))


@dataclass
class Model:
    """Languages in code-point order; log probabilities of trigram and word buckets; allowed[script, language]."""

    languages: list[str]
    trigram: np.ndarray
    word: np.ndarray
    allowed: np.ndarray

    def scores(self, w: Words) -> np.ndarray:
        """Score of every word for every language, 0 for the best; all 0 where no language writes the script."""
        out = np.empty((len(w.word), len(self.languages)), np.float32)
        for k in range(len(self.languages)):
            out[:, k] = np.add.reduceat(self.trigram[k][w.trigrams], w.first) + self.word[k][w.word] if len(w.word) else 0
        able = self.allowed[w.script]
        out = np.where(able, out, np.float32(_FORBIDDEN))
        out -= out.max(axis=1, keepdims=True) if len(out) else 0
        out[~able.any(axis=1)] = 0
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _training_counts(batches):
    """(language, bucket, n): trigram buckets, then word buckets, then letters per script."""
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in row_slices(batch, "text", _PIECE):
            texts, langs = part.column(0).to_pylist(), np.array(part.column(1).to_pylist(), object)
            for lang in sorted(set(langs.tolist())):
                w = words_of([t for t, x in zip(texts, langs) if x == lang])
                n = seen.setdefault(lang, np.zeros(2 * BUCKETS + N_SCRIPTS, np.int64))
                n[:BUCKETS] += np.bincount(w.trigrams, minlength=BUCKETS)
                n[BUCKETS:2 * BUCKETS] += np.bincount(w.word, minlength=BUCKETS)
                n[2 * BUCKETS:] += np.bincount(w.script, w.letters, N_SCRIPTS).astype(np.int64)
    for lang, n in seen.items():
        for b in np.flatnonzero(n):
            yield lang, int(b), int(n[b])


def train(docs: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learn from about ``sample`` documents of each non-null lang among those not held out.

    What reaches the driver is one count per language and one per (language,
    bucket): bounded by the number of languages, not by the corpus.  More
    than ``MOST_LANGUAGES`` distinct values are an error: such a column holds
    no languages.
    """
    labelled = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"),
                           F.col("lang").cast("string").alias("lang")).filter(
        F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).take(MOST_LANGUAGES + 1)}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of lang")
    if not sizes:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros((0, BUCKETS), np.float32),
                     np.zeros((N_SCRIPTS, 0), bool))
    grain = 1 << 30
    limit = F.create_map(*[x for lang, n in sizes.items()
                           for x in (F.lit(lang), F.lit(min(grain, grain * sample // n)).cast("long"))])
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(grain))
    chosen = labelled.filter(F.col("text").isNotNull() & (draw < limit[F.col("lang")])).select("text", "lang")
    rows = map_rows(chosen, _training_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n")).toArrow()
    languages = sorted(sizes, key=lambda x: x.encode())
    number = {x: i for i, x in enumerate(languages)}
    counts = np.zeros((len(languages), 2 * BUCKETS + N_SCRIPTS))
    if rows.num_rows:
        lang = np.array([number[x] for x in rows.column("lang").to_pylist()])
        counts[lang, rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    log = lambda c: np.log((c + SMOOTHING) / (c.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)).astype(np.float32)
    letters = counts[:, 2 * BUCKETS:]
    share = letters / np.maximum(letters.sum(axis=1, keepdims=True), 1)
    return Model(languages, log(counts[:, :BUCKETS]), log(counts[:, BUCKETS:2 * BUCKETS]), (share >= MIN_SCRIPT_SHARE).T)


def best_path(scores: np.ndarray, text: np.ndarray, penalty: float, chunk: int = CHUNK) -> np.ndarray:
    """Language of every word: the best sequence of each text, ``penalty`` per switch.

    ``text`` numbers the texts of the words, in ascending order.
    """
    n, k = scores.shape
    if not n:
        return np.zeros(0, np.int64)
    begin = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    size = np.diff(np.concatenate([begin, [n]]))
    parts = -(-size // chunk)
    owner = np.repeat(np.arange(len(begin)), parts)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = begin[owner] + index * chunk
    length = np.minimum(chunk, size[owner] - index * chunk)
    order = np.argsort(-length, kind="stable")
    start_o, length_o = start[order], length[order]
    span = int(length_o[0])
    # Chunks that still have a word at place t.
    running = [int(np.searchsorted(-length_o, -t, "left")) for t in range(span)]
    # value[c, s, l]: best path of chunk c that comes from language s and stands in l.
    value = np.where(np.eye(k, dtype=bool), 0, -penalty)[None] + scores[start_o][:, None, :]
    for t in range(1, span):
        v = value[:running[t]]
        value[:running[t]] = np.maximum(v, v.max(axis=2, keepdims=True) - penalty) + scores[start_o[:running[t]] + t][:, None, :]
    through = np.empty_like(value)
    through[order] = value
    # Chain the chunks of each text; before the first chunk every language is free.
    first = np.cumsum(parts) - parts
    here = through[first].max(axis=1)
    came = np.zeros((len(owner), k), np.int64)
    came[first] = through[first].argmax(axis=1)
    for i in range(1, int(parts.max())):
        live = np.flatnonzero(parts > i)
        total = here[live][:, :, None] + through[first[live] + i]
        came[first[live] + i] = total.argmax(axis=1)
        here[live] = total.max(axis=1)
    ends = np.zeros(len(owner), np.int64)
    comes = np.zeros(len(owner), np.int64)
    state = here.argmax(axis=1)
    for i in range(int(parts.max()) - 1, -1, -1):
        live = np.flatnonzero(parts > i)
        c = first[live] + i
        ends[c] = state[live]
        comes[c] = came[c, state[live]]
        state[live] = comes[c]
    # Once more from the language each chunk is known to come from: whether a
    # word's language was kept, and the one left for all others.
    now, source = ends[order], comes[order]
    kept, left = np.ones((n, k), bool), np.zeros(n, np.int64)
    value = np.where(np.arange(k) == source[:, None], 0, -penalty) + scores[start_o]
    for t in range(1, span):
        v = value[:running[t]]
        leave = v.max(axis=1) - penalty
        stay = v >= leave[:, None]
        at = start_o[:running[t]] + t
        kept[at], left[at] = stay, v.argmax(axis=1)
        value[:running[t]] = np.where(stay, v, leave[:, None]) + scores[at]
    path = np.zeros(n, np.int64)
    for t in range(span - 1, -1, -1):
        m = running[t]
        at = start_o[:m] + t
        path[at] = now[:m]
        if t:
            now[:m] = np.where(kept[at, now[:m]], now[:m], left[at])
    return path


def _label(texts: list[str | None], model: Model, penalty: float):
    """Per text: (language, score, spans)."""
    w = words_of([t or "" for t in texts])
    if not model.languages:
        for _ in texts:
            yield UNDETERMINED, 0.0, []
        return
    path = best_path(model.scores(w), w.text, penalty)
    size = w.letters
    # Letters of a script that the language does not write are no letters of that language.
    letters = np.bincount(w.text * len(model.languages) + path, size * model.allowed[w.script, path],
                          w.n_texts * len(model.languages)).reshape(w.n_texts, -1)
    total = np.bincount(w.text, size, w.n_texts)
    cut = np.searchsorted(w.text, np.arange(w.n_texts + 1))
    change = np.ones(len(path), bool)
    change[1:] = (path[1:] != path[:-1]) | (w.text[1:] != w.text[:-1])
    for i in range(w.n_texts):
        a, b = int(cut[i]), int(cut[i + 1])
        if a == b:
            yield UNDETERMINED, 0.0, []
            continue
        best = int(letters[i].argmax())
        heads = np.flatnonzero(change[a:b]) + a
        lasts = np.concatenate([heads[1:], [b]]) - 1
        yield (model.languages[best], float(letters[i][best] / total[i]),
               [{"from": int(w.start[h]), "to": int(w.end[e]), "lang": model.languages[path[h]]}
                for h, e in zip(heads, lasts)])


_SPANS = "array<struct<from:int,to:int,lang:string>>"


def label_languages(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """doc_id, lang_pred, score, spans (code points, end exclusive) of every row of ``docs`` (doc_id, text).

    ``score`` is the share of the text's letters that stand in spans of
    ``lang_pred`` and in a script which that language writes: 0 for a text
    wholly in a script that no learned language writes (its label is then the
    first language).  A null text, one without letters, and every text if no language was learned
    give ``und``, 0 and no spans.  Equal rows get equal results; an empty
    table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for batch in batches:
            for part in row_slices(batch, "text", _PIECE):
                ids = part.column(0).to_pylist()
                for doc, (lang, score, spans) in zip(ids, _label(part.column(1).to_pylist(), held.value, penalty)):
                    yield doc, lang, score, spans
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(narrow, rows, f"doc_id long, lang_pred string, score double, spans {_SPANS}")


def identify(docs: DataFrame, sample: int = SAMPLE_PER_LANGUAGE, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """Train on the documents that are not held out, label all: doc_id, held_out, lang_pred, score, spans."""
    done = label_languages(docs, train(docs, sample), penalty)
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")


MIN_SCORE = 0.5


def accepted(docs: DataFrame, model: Model, min_score: float = MIN_SCORE, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language for at least ``min_score`` of its letters."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for batch in batches:
            for part in row_slices(batch, "text", _PIECE):
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                keep = [lang != UNDETERMINED and score >= min_score
                        for lang, score, _ in _label(texts, held.value, penalty)]
                yield part.filter(pa.array(keep, pa.bool_()))
    return map_batches(docs, rows, docs.schema)
