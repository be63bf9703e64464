"""Secret scan: fixed patterns plus a battery of randomness tests.

Three kinds of spans come from patterns.  Further candidates are long runs
of characters that encodings use, less the spans of the patterns, and the parts
of such a run; of nested ones that are found the outermost counts.  For each the encoding is inferred from
its characters, and two questions are asked:

* Is it compatible with uniform random symbols of that encoding?
  Chi-squared uniformity (through the coincidence rate of symbols), a runs
  test about the middle of the alphabet and the lag-1 serial correlation
  must not reject it.
* Would ordinary text of this length look like it?  The coincidence rate and
  the changes between lower case, upper case and digits are compared with
  those of the whole corpus; both tests know the length of the string.  Their
  combined p-values, over all candidates of the corpus, pass a
  Benjamini-Hochberg step, so the share of false findings is controlled.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.arrow import map_batches, map_rows
from parlance.llm.words import row_slices, string_buffers
from parlance.plans.ordering import materialize

# The base kinds in their order, pattern and least length (of group 2 where there is one).
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.IGNORECASE | re.ASCII), 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 24),
}
FOUND = "random"
KINDS = (*BASE, FOUND)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
LEAST = 20
_SEPARATORS = "/_-"
_PART = re.compile(r"[^/_-]+")
FALSE_DISCOVERIES = 0.01
# A candidate is not random if one of the uniformity tests falls below this.
REJECT = 0.001
_BINS_PER_DECADE = 20
# Smaller p-values share a bin: each is under share / total by itself, whatever the corpus.
_LAST_DECADE = 300.0

_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# Alphabets from the smallest to the largest; the first that holds all characters is the encoding.
ENCODINGS = [("decimal", _DIGIT), ("hex", _DIGIT + "abcdef"), ("HEX", _DIGIT + "ABCDEF"), ("lower", _LOWER),
             ("upper", _UPPER), ("base32", _UPPER + "234567"), ("base36", _DIGIT + _LOWER), ("BASE36", _DIGIT + _UPPER),
             ("base62", _UPPER + _LOWER + _DIGIT), ("base64", _UPPER + _LOWER + _DIGIT + "+/"),
             ("base64url", _UPPER + _LOWER + _DIGIT + "-_"), ("mixed", _UPPER + _LOWER + _DIGIT + "+/-_")]
_SETS = [frozenset(a) for _, a in ENCODINGS]
_CLASS = {c: k for k, s in enumerate((_LOWER, _UPPER, _DIGIT, "+/-_")) for c in s}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, by start, then kind."""
    out = []
    for k, (pattern, least) in enumerate(BASE.values()):
        for m in pattern.finditer(text):
            value = m.group(2) if pattern.groups else m.group()
            if len(value) >= least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@dataclass(frozen=True)
class Profile:
    """Ordinary text: counts of the 128 ASCII characters; how often neighbours change between character classes."""

    counts: tuple[int, ...]
    changes: float

    @cached_property
    def gains(self) -> np.ndarray:
        """Per ASCII character: log odds of a uniform base64 symbol against ordinary text."""
        n = np.array(self.counts) + 1.0
        inside = np.zeros(128, bool)
        inside[[ord(c) for c in _CLASS]] = True
        return np.where(inside, math.log(1 / 64) - np.log(n / n[inside].sum()), 0.0)

    def rates(self, alphabet: str) -> tuple[float, float]:
        """Sums of squares and cubes of the shares of the alphabet's characters (one pseudo-count each)."""
        n = np.array([self.counts[ord(c)] + 1.0 for c in alphabet])
        p = n / n.sum()
        return float((p ** 2).sum()), float((p ** 3).sum())


_CODE_CLASS = np.zeros(256, np.int8)
for _c, _k in _CLASS.items():
    _CODE_CLASS[ord(_c)] = _k + 1


def _profile_rows(batches):
    counts = np.zeros(256, np.int64)
    pairs = changed = 0
    for batch in batches:
        for part in row_slices(batch, "text", 4 << 20):
            data, _ = string_buffers(part.column(0))
            counts += np.bincount(data, minlength=256)
            k = _CODE_CLASS[data]
            both = (k[1:] > 0) & (k[:-1] > 0)
            pairs += int(both.sum())
            changed += int((both & (k[1:] != k[:-1])).sum())
    for b in np.flatnonzero(counts[:128]):
        yield int(b), int(counts[b])
    yield -1, pairs
    yield -2, changed


def corpus_profile(docs: DataFrame) -> Profile:
    """Character statistics of all texts; 130 numbers reach the driver."""
    text = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = map_rows(text, _profile_rows, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()
    n = {r["symbol"]: r["n"] for r in rows}
    return Profile(tuple(n.get(b, 0) for b in range(128)), (n.get(-2, 0) + 1) / (n.get(-1, 0) + 20))


def _above(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _log_above(z: float) -> float:
    """Logarithm of ``_above``; by the first terms of its asymptotic series where erfc comes near 0."""
    if z < 30:
        return math.log(_above(z))
    return -z * z / 2 - math.log(z * math.sqrt(2 * math.pi)) + math.log1p(-1 / z ** 2 + 3 / z ** 4)


def _rate_deviation(n: int, squares: float, cubes: float) -> float:
    """Standard deviation of the coincidence rate of n independent symbols (variance of a U-statistic)."""
    var = (4 * (n - 2) * (cubes - squares ** 2) + 2 * (squares - squares ** 2)) / (n * (n - 1))
    return math.sqrt(max(var, 1e-18))


def ordinary_p(value: str, profile: Profile) -> float:
    """Probability that ordinary text looks as random as ``value``; 1 if ``value`` is not uniform in its encoding."""
    return math.exp(ordinary_log_p(value, profile))


def ordinary_log_p(value: str, profile: Profile) -> float:
    """Logarithm of ``ordinary_p``, which itself is 0 in floating point for runs of many hundred characters."""
    value = value.rstrip("=")
    n = len(value)
    symbols = frozenset(value)
    alphabet = next(a for (_, a), s in zip(ENCODINGS, _SETS) if symbols <= s)
    size = len(alphabet)
    place = {c: i for i, c in enumerate(alphabet)}
    x = np.array([place[c] for c in value])
    count = np.bincount(x, minlength=size).astype(float)
    rate = float((count * (count - 1)).sum()) / (n * (n - 1))
    uniform = [_above((rate - 1 / size) / _rate_deviation(n, 1 / size, 1 / size ** 2))]
    high = x >= size / 2
    n1, n2 = int(high.sum()), int(n - high.sum())
    if not n1 or not n2:
        return 0.0
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 1 + 2 * n1 * n2 / n
    dev = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    uniform.append(2 * _above(abs(runs - mean) / dev))
    spread = x.std()
    if spread == 0:
        return 0.0
    serial = float(((x[1:] - x.mean()) * (x[:-1] - x.mean())).sum() / (n * spread ** 2))
    uniform.append(2 * _above(abs(serial + 1 / n) * math.sqrt(n)))
    if min(uniform) < REJECT:
        return 0.0
    squares, cubes = profile.rates(alphabet)
    log_rate = _log_above((squares - rate) / _rate_deviation(n, squares, cubes))
    kinds = np.array([_CLASS[c] for c in value])
    share = float((kinds[1:] != kinds[:-1]).mean())
    log_change = 0.0
    if share > profile.changes:
        # Chernoff bound of the binomial tail.
        t = min(profile.changes, 1 - 1e-9)
        gain = share * math.log(share / t) + ((1 - share) * math.log((1 - share) / (1 - t)) if share < 1 else 0.0)
        log_change = -(n - 1) * gain
    half = -(log_rate + log_change)
    return min(0.0, math.log1p(half) - half)


def _pieces(start: int, end: int, base: list[tuple[int, int, int]]):
    """What the base spans (by start) leave of a run; separators beside a cut go with it."""
    at = start
    for s, _, e in base:
        if s < end and at < e:
            if at < s:
                yield at, s
            at = e
    if at < end:
        yield at, end


def _best_range(parts: list[tuple[int, int]], text: str, gains: np.ndarray) -> tuple[int, int]:
    """First and last of the adjoining parts that favour random symbols over ordinary text most (greatest sum)."""
    best, here, first, found = -math.inf, 0.0, 0, (0, len(parts) - 1)
    for i, (s, e) in enumerate(parts):
        if here <= 0:
            here, first = 0.0, i
        here += float(gains[np.frombuffer(text[s:e].encode("ascii"), np.uint8)].sum())
        if here > best:
            best, found = here, (first, i)
    return found


def candidates(text: str, base: list[tuple[int, int, int]], profile: Profile) -> list[tuple[int, int, float, float]]:
    """(start, end, log10 p, least log10 p of the candidates around it or 1) of the candidates of ``text``.

    Candidates are what the base spans leave of each run, the parts between
    its separators, and its range of adjoining parts that looks most random,
    whose p-value is multiplied by the number of ranges it was chosen from.
    """
    out = []
    for m in CANDIDATE.finditer(text):
        for start, end in _pieces(m.start(), m.end(), base):
            while start < end and start > m.start() and text[start] in _SEPARATORS:
                start += 1
            while start < end and end < m.end() and text[end - 1] in _SEPARATORS:
                end -= 1
            if len(text[start:end].rstrip("=")) < LEAST:
                continue
            log_p = lambda s, e: ordinary_log_p(text[s:e], profile) / math.log(10)
            whole = log_p(start, end)
            out.append((start, end, whole, 1.0))
            parts = [(start + x.start(), start + x.end()) for x in _PART.finditer(text[start:end])]
            if len(parts) < 2:
                continue
            first, last = _best_range(parts, text, profile.gains)
            s, e = parts[first][0], parts[last][1]
            inner = 1.0
            if first < last and (first > 0 or last < len(parts) - 1) and len(text[s:e].rstrip("=")) >= LEAST:
                inner = min(0.0, log_p(s, e) + math.log10(len(parts) * (len(parts) + 1) / 2))
                out.append((s, e, inner, whole))
            for i, (s, e) in enumerate(parts):
                if len(text[s:e].rstrip("=")) >= LEAST:
                    out.append((s, e, log_p(s, e), min(whole, inner) if first <= i <= last else whole))
    return out


def _scan_rows(batches, profile: Profile):
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for doc, value in zip(ids, texts):
            text = value.as_py() or ""
            base = base_spans(text)
            yield (doc, [{"start": s, "kind": k, "end": e} for s, k, e in base],
                   [{"start": s, "end": e, "log10_p": p, "around": o} for s, e, p, o in candidates(text, base, profile)])


_SCANNED = ("doc_id long, base array<struct<start:int,kind:int,end:int>>, "
            "candidates array<struct<start:int,end:int,log10_p:double,around:double>>")


def scan(docs: DataFrame, profile: Profile) -> DataFrame:
    """doc_id, base spans and candidates with the logarithms of their p-values, one row per row of ``docs``."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(narrow, lambda it: _scan_rows(it, profile), _SCANNED)


def discovery_limit(scanned: DataFrame, share: float = FALSE_DISCOVERIES) -> float:
    """Benjamini-Hochberg limit (log10) over the p-values of all candidates, from a histogram of bounded size."""
    p = scanned.select(F.explode("candidates.log10_p").alias("log10_p"))
    place = F.least(-F.col("log10_p"), F.lit(_LAST_DECADE)) * _BINS_PER_DECADE
    bins = p.groupBy(F.floor(place).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    total, below, limit = sum(r["n"] for r in bins), 0, -math.inf
    for r in sorted(bins, key=lambda r: -r["bin"]):
        below += r["n"]
        # All of a bin lies at or under its upper edge.
        edge = -r["bin"] / _BINS_PER_DECADE
        if edge <= math.log10(share * below / total):
            limit = edge
    return limit


def _joined(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, share: float = FALSE_DISCOVERIES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans of every row of ``docs`` (doc_id, text).

    Spans are kind:start:end in code points, end exclusive, by start, then
    kind.  A null or empty text has none.  Equal rows get equal results; an
    empty table gives no rows.
    """
    scanned = materialize(scan(docs, corpus_profile(docs)))
    limit = discovery_limit(scanned, share)
    extra = F.transform(F.filter("candidates", lambda c: (c["log10_p"] <= limit) & (c["around"] > limit)), lambda c: F.struct(
        c["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), c["end"].alias("end")))
    both = scanned.select("doc_id", "base", F.sort_array(F.concat("base", extra)).alias("all"))
    of = lambda k: F.size(F.filter("all", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return both.select("doc_id", *[of(k) for k in range(len(KINDS))],
                       F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                       _joined(F.col("all")).alias("spans"))


MASK = "[SECRET]"


def masked(text: str, profile: Profile, limit: float) -> str:
    """``text`` with every span replaced; spans that touch are replaced together."""
    base = base_spans(text)
    spans = sorted([(s, e) for s, _, e in base] + [(s, e) for s, e, p, _ in candidates(text, base, profile) if p <= limit])
    out, at = [], 0
    for s, e in spans:
        if s >= at:
            out += [text[at:s], MASK]
        at = max(at, e)
    return "".join([*out, text[at:]]) if spans else text


def _masked_rows(batches, profile: Profile, limit: float):
    for batch in batches:
        k = batch.schema.get_field_index("text")
        new = [t if t is None else masked(t, profile, limit) for t in batch.column(k).to_pylist()]
        cols = [pa.array(new, batch.schema.field(i).type) if i == k else c for i, c in enumerate(batch.columns)]
        yield pa.record_batch(cols, schema=batch.schema)


def mask_secrets(docs: DataFrame, share: float = FALSE_DISCOVERIES) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by a mask; a null text stays null."""
    profile = corpus_profile(docs)
    limit = discovery_limit(materialize(scan(docs, profile).select("candidates")), share)
    return map_batches(docs, lambda it: _masked_rows(it, profile, limit), docs.schema)
