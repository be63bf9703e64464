"""Main text of web pages by a suffix array over the pages of a host.

The visible words of a host's pages are put one after another; the suffixes
are sorted by prefix doubling as deep as a boilerplate run is long.  Equal
neighbours that start on distinct pages are repeats, and every word that a
repeat covers counts as covered.  What is not covered are a page's unique
runs; the element that holds most of them is its main element, and its
covered words leave.

The suffix array sees every visible word, in articles too.  What marks itself
as an article is taken at its word: all articles of a page are its main
elements, and runs that they share with other pages are shared passages or
copies, which are content; coverage decides there which parts with a name like
that of a menu are one.  A notice that was put into articles goes: a block of
its own of at least ``MIN_RUN`` words that stands on most pages of the host
(``NOTICE_SHARE``, and ``NOTICE_PAGES`` at least) and, with the others like
it, makes up at most half of the page.  A page without an article that is
covered for the most part is a copy of another: its covered words stay, but
for such notices.

Elements that mark themselves as menus, headers, footers, sidebars, notices,
adverts, forms or comments never count, so a host with a single page, whose
suffix array has no repeats, gives the same text.

A host's pages are dealt into shards of bounded size, one suffix array each.
A page is read once; what was read of it is packed, shuffled to its shard once
and read there three times.  For a host of several shards the runs meet twice
in buckets: first short prints of all of them, then the whole 64-bit hashes of
those whose print stands in more than one shard.  The hashes that do come back
to their shards, in as many bits as tell them from the shard's other runs:
repeats are those of the whole host, however many pages it has.  Blocks are counted per host on the same way, once per page.
"""

from __future__ import annotations

import html as entities
import json
import re
import struct
from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.arrow import arrow_schema, map_rows, python_path, rebatch
from parlance.plans.ordering import materialize

MIN_RUN = 6
SHARD_PAGES = 2048
SHARD_BYTES = 8 << 20
# A block is a notice beyond this share of a host's pages, and on so many pages at least.
NOTICE_SHARE, NOTICE_PAGES = 0.5, 5
# A page is a copy if more of its words are covered; notices that make up more of a page stay.
COPY_SHARE = 0.5
# Pages that are packed together.
PACK_PAGES = 256
_CODEC = pa.Codec("zstd", compression_level=6)
# Shards of a host per bucket of runs; bits of a print, which one in some hundred runs shares with another by chance.
BUCKET_SHARDS = 4
PRINT_BITS = 28
# Rows (host, shards) that may be broadcast: some 20 MB; beyond, the join shuffles.
BROADCAST_HOSTS = 200_000
# Share of an element's words that a child must hold to be the main element in its place.
DESCEND = 0.6

# Elements by what they do to a text.
RAW = frozenset("script style noscript template iframe svg math object textarea select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr img".split())
CONTAINERS = frozenset("html body div section article main nav header footer aside form ul ol dl table tbody thead "
                       "tfoot tr td th center details dialog figure fieldset menu head blockquote".split())
ARTICLES = frozenset(("article", "main"))
CHROME = frozenset("nav footer aside form dialog menu head fieldset".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
CHROME_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements sponsor sponsored sponsors promo promos promotion banner "
    "banners cookie cookies consent gdpr notice notices notification notifications alert sidebar side aside menu menus "
    "nav navbar navigation navigator breadcrumb breadcrumbs header masthead footer foot comment comments reply replies "
    "respond disqus discussion social share sharing related recommended recommendations newsletter subscribe "
    "subscription signup login popup modal overlay widget widgets toolbar pagination pager paging search skip form "
    "copyright legal disclaimer".split())

_TAG = re.compile(r"""<!--(?:[\s\S]*?)(?:-->|\Z)|<!\[CDATA\[[\s\S]*?(?:\]\]>|\Z)|<[!?][^>]*+>?"""
                  r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-z0-9]+")
_NUMBER = re.compile(r"[-_]?[0-9]+$")
# Share of the page's unique words beyond which a whole name, or a piece of one, marks no chrome.
MOST_WHOLE, MOST_PIECE = 0.9, 0.5


class Page:
    """Blocks of one page: text, element and whether an element around it is chrome."""

    def __init__(self, source: str):
        self.parent, self.tag, self.chrome, self.named = [-1], ["#root"], [False], [0]
        self.blocks: list[tuple[str, int]] = []
        self._held: list[str] = []
        self._read(source)

    def dumps(self) -> str:
        """What was read of the page, as a string: a line of numbers, then a line per block."""
        flags = [(t in ARTICLES) + 2 * c + 4 * m for t, c, m in zip(self.tag, self.chrome, self.named)]
        numbers = json.dumps([self.parent, flags, [e for _, e in self.blocks]], separators=(",", ":"))
        return "\n".join([numbers, *(text for text, _ in self.blocks)])

    @classmethod
    def loads(cls, held: str) -> Page:
        numbers, *texts = held.split("\n")
        page = cls("")
        page.parent, flags, elements = json.loads(numbers)
        page.tag = ["article" if f & 1 else "" for f in flags]
        page.chrome = [bool(f & 2) for f in flags]
        page.named = [f >> 2 for f in flags]
        page.blocks = list(zip(texts, elements))
        return page

    def _flush(self, element: int) -> None:
        text = " ".join(entities.unescape("".join(self._held)).split()) if self._held else ""
        self._held = []
        if text:
            self.blocks.append((text, element))

    def _read(self, source: str) -> None:
        at, here, n = 0, 0, len(source)
        while at < n:
            m = _TAG.search(source, at)
            if not m:
                self._held.append(source[at:])
                break
            if m.start() > at:
                self._held.append(source[at:m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
            if name in RAW and not closing:
                if not attributes.endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.IGNORECASE).search(source, at)
                    at = end.end() if end else n
                continue
            if name in INLINE:
                continue
            self._flush(here)
            if name not in CONTAINERS or name in VOID:
                continue
            if closing:
                up = here
                while up > 0 and self.tag[up] != name:
                    up = self.parent[up]
                if up > 0:
                    here = self.parent[up]
            else:
                if name == "body":
                    while here > 0 and self.tag[here] == "head":
                        here = self.parent[here]
                self.parent.append(here)
                self.tag.append(name)
                self.chrome.append(self.chrome[here] or self._is_chrome(name, attributes, here))
                self.named.append(self._name_mark(name, attributes))
                here = len(self.tag) - 1
        self._flush(here)

    def _is_chrome(self, name: str, attributes: str, parent: int) -> bool:
        if name in CHROME:
            return True
        if name == "header":
            while parent > 0 and self.tag[parent] not in ARTICLES:
                parent = self.parent[parent]
            return parent <= 0
        if not attributes.strip() or name in ("html", "body", "main"):
            return False
        found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
        if "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", "")):
            return True
        return found.get("role", "").lower() in CHROME_ROLES

    def _name_mark(self, name: str, attributes: str) -> int:
        """What a class or id says of an element: 2 if a whole name is chrome, 1 if a piece of one is, else 0."""
        if not attributes.strip() or name in ("html", "body") or name in ARTICLES:
            return 0
        found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
        names = [x for k in ("class", "id") for x in found.get(k, "").lower().split()]
        if any(_NUMBER.sub("", x) in CHROME_NAMES for x in names):
            return 2
        return int(any(piece in CHROME_NAMES for x in names for piece in _NAME.findall(x)))

    def settle(self, unique: list[int], words: list[int]) -> None:
        """Decide which names mark chrome, from the words and unique words of the blocks.

        A name marks no element that holds an article, but for a whole name
        if there is an article elsewhere.  In an article only whole names
        mark, or a piece where all words are covered and others are not.
        Elsewhere it marks none that holds most of the page's unique words.
        """
        if not any(self.named):
            return
        n = len(self.tag)
        own, size, held, article = ([0] * n for _ in range(4))
        for (_, e), u, w in zip(self.blocks, unique, words):
            if not self.chrome[e]:
                own[e] += u
                size[e] += w
        for e in range(n - 1, 0, -1):
            own[self.parent[e]] += own[e]
            size[self.parent[e]] += size[e]
        articles = [e for e in range(1, n) if self.tag[e] in ARTICLES and not self.chrome[e] and size[e] > 0]
        for e in articles:
            held[e] = 1
        for e in range(n - 1, 0, -1):
            held[self.parent[e]] += held[e]
        marked, hidden = [False] * n, [False] * n
        for e in range(1, n):
            up = self.parent[e]
            article[e] = e if self.tag[e] in ARTICLES else article[up]
            whole = self.named[e] == 2
            if not self.named[e]:
                pass
            elif held[e]:
                marked[e] = whole and held[e] < len(articles)
            elif article[up]:
                marked[e] = whole or (own[e] == 0 and own[article[up]] > 0)
            else:
                marked[e] = own[e] <= (MOST_WHOLE if whole else MOST_PIECE) * own[0]
            hidden[e] = hidden[up] or marked[e]
        if articles and all(hidden[e] for e in articles):
            e = max(articles, key=lambda e: (own[e] + size[e], -e))
            while e > 0:
                marked[e] = False
                e = self.parent[e]
        for e in range(1, n):
            self.chrome[e] = bool(self.chrome[e] or marked[e] or self.chrome[self.parent[e]])

    def weights(self, unique: list[int], words: list[int]) -> list[int]:
        """Words plus unique words below every element, chrome left out."""
        w = [0] * len(self.tag)
        for (_, e), u, n in zip(self.blocks, unique, words):
            if not self.chrome[e]:
                w[e] += u + n
        for e in range(len(w) - 1, 0, -1):
            w[self.parent[e]] += w[e]
        return w

    def main_elements(self, weight: list[int]) -> tuple[list[int], bool]:
        """(elements, whether they mark themselves as articles): all outermost articles, or the one main element.

        Where articles inside of an article hold most of it, they stand in its place.
        """
        articles = [e for e, t in enumerate(self.tag) if t in ARTICLES and not self.chrome[e] and weight[e] > 0]
        if articles:
            out, todo = [], self._outermost(articles)
            while todo:
                e = todo.pop()
                inner = self._outermost([x for x in articles if x > e and self._inside(x, e)])
                if sum(weight[x] for x in inner) >= DESCEND * weight[e]:
                    todo += inner
                else:
                    out.append(e)
            return sorted(out), True
        best = 0
        while True:
            inner = [e for e in range(best + 1, len(self.tag)) if self.parent[e] == best and not self.chrome[e]
                     and weight[e] >= DESCEND * weight[best] and weight[e] > 0]
            if not inner:
                return [best], False
            best = max(inner, key=lambda e: (weight[e], -e))

    def _outermost(self, elements: list[int]) -> list[int]:
        among = set(elements)
        out = []
        for e in elements:
            up = self.parent[e]
            while up > 0 and up not in among:
                up = self.parent[up]
            if up <= 0:
                out.append(e)
        return out

    def _inside(self, e: int, outer: int) -> bool:
        while e > outer:
            e = self.parent[e]
        return e == outer


def covered_words(words: np.ndarray, page: np.ndarray, depth: int = MIN_RUN) -> np.ndarray:
    """Which words lie in a run of at least ``depth`` words that also stands on another page.

    ``words`` are numbers, ``page`` the page of each word in ascending order.
    Suffixes are ranked by their first 1, 2, 4, ... words until the ranks
    reach ``depth``; a suffix that leaves its page ranks by itself.
    """
    n = len(words)
    covered = np.zeros(n, bool)
    if n < depth:
        return covered
    left = np.searchsorted(page, page, "right") - np.arange(n)
    rank, length = words - words.min(), 1
    steps = {1: rank}
    while 2 * length <= depth:
        rank = _pairs(rank, rank, length)
        length *= 2
        steps[length] = rank
    for part in sorted(steps, reverse=True):
        if length + part <= depth:
            rank = _pairs(rank, steps[part], length)
            length += part
    # The suffix array: places by rank; equal neighbours share their first words.
    whole = np.flatnonzero(left >= depth)
    if not len(whole):
        return covered
    order = whole[np.argsort(rank[whole], kind="stable")]
    same = rank[order][1:] == rank[order][:-1]
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    low, high = np.minimum.reduceat(page[order], head), np.maximum.reduceat(page[order], head)
    repeated = np.repeat(low != high, np.diff(np.concatenate([head, [len(order)]])))
    return _spread(order[repeated], n, depth)


def _spread(starts: np.ndarray, n: int, depth: int = MIN_RUN) -> np.ndarray:
    """Which of ``n`` words lie in a run of ``depth`` words from one of the distinct ``starts``."""
    delta = np.zeros(n + 1, np.int8)
    delta[starts] += 1
    delta[starts + depth] -= 1
    return np.cumsum(delta, dtype=np.int64)[:n] > 0


def _pairs(first: np.ndarray, second: np.ndarray, shift: int) -> np.ndarray:
    """Ranks of (first[i], second[i + shift])."""
    behind = np.full(len(first), -1, np.int64)
    behind[:-shift] = second[shift:]
    return np.unique(first.astype(np.int64) * (int(second.max()) + 2) + behind + 1, return_inverse=True)[1]


def _word_hash(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def run_hashes(words: np.ndarray, depth: int = MIN_RUN) -> np.ndarray:
    """Hashes of all runs of ``depth`` words, from the hashes of the words."""
    n = max(len(words) - depth + 1, 0)
    h = np.zeros(n, np.uint64)
    for i in range(depth):
        h = (h ^ words[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def block_hash(text: str) -> int:
    """A 64-bit hash of a block, as a signed number."""
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _is_run(text: str) -> bool:
    return text.count(" ") >= MIN_RUN - 1


def _in_order(ids: list) -> list[int]:
    return sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))


def _words_of(pages: list[Page], ids: list) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Number and page of every word of the pages as they are ordered, and the word of each number."""
    texts = [" ".join(text for text, _ in p.blocks) for p in pages]
    known: dict = {}
    page = [known.setdefault(i, len(known)) for i in ids]
    split = pc.split_pattern(pa.array([x for x in texts if x], pa.large_string()), " ")
    counts = np.zeros(len(pages), np.int64)
    counts[[bool(x) for x in texts]] = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    words = split.flatten().dictionary_encode()
    return (words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.array(page, np.int64), counts),
            words.dictionary.to_pylist())


def _runs_of(numbered: np.ndarray, owners: np.ndarray, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all runs that lie within a page."""
    if len(numbered) < MIN_RUN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = run_hashes(np.array([_word_hash(x) for x in vocabulary], np.uint64)[numbered])
    starts = np.flatnonzero(owners[:len(hashes)] == owners[MIN_RUN - 1:])
    return starts, hashes[starts]


def shard_texts(pages: list[Page], ids: list, repeated: Callable | None = None, notices: frozenset = frozenset()) -> list[str]:
    """Main text of every page of one shard; ``ids`` tell distinct pages apart.

    ``repeated`` tells which of some runs, by their hashes, also stand in other
    shards; ``notices`` has the hashes of the blocks that stand on most pages
    of the host.
    """
    order = _in_order(ids)
    numbered, owners, vocabulary = _words_of([pages[i] for i in order], [ids[i] for i in order])
    covered = covered_words(numbered, owners)
    if repeated is not None:
        starts, hashes = _runs_of(numbered, owners, vocabulary)
        covered |= _spread(starts[repeated(hashes)], len(covered))
    ahead = np.concatenate([[0], np.cumsum(covered)])
    size = [[text.count(" ") + 1 for text, _ in pages[i].blocks] for i in order]
    ends = np.cumsum([w for some in size for w in some], dtype=np.int64)
    counts = np.diff(ahead[ends], prepend=0).tolist()
    out: list[str] = [""] * len(pages)
    at = block = 0
    for i, words in zip(order, size):
        total = sum(words)
        out[i] = _page_text(pages[i], words, counts[block:block + len(words)], covered[at:at + total], notices)
        at += total
        block += len(words)
    return out


def _page_text(p: Page, size: list[int], counts: list[int], covered: np.ndarray, notices: frozenset) -> str:
    """The main text of a page of whose words some are ``covered``: ``counts`` of the ``size`` words of each block."""
    notice = [bool(notices) and _is_run(text) and block_hash(text) in notices for text, _ in p.blocks]
    unique = [0 if n else w - c for w, c, n in zip(size, counts, notice)]
    p.settle(unique, size)
    mains, marked = p.main_elements(p.weights(unique, size))
    own = [k for k, (_, e) in enumerate(p.blocks) if not p.chrome[e] and any(p._inside(e, m) for m in mains)]
    total = sum(size[k] for k in own)
    if sum(size[k] for k in own if notice[k]) <= COPY_SHARE * total:
        own = [k for k in own if not notice[k]]
    if marked or sum(counts[k] for k in own) > COPY_SHARE * sum(size[k] for k in own):
        return " ".join(p.blocks[k][0] for k in own)
    at, covered = np.cumsum([0, *size]).tolist(), covered.tolist()
    kept = (" ".join(x for x, c in zip(p.blocks[k][0].split(" "), covered[at[k]:at[k + 1]]) if not c) if counts[k]
            else p.blocks[k][0] for k in own)
    return " ".join(x for x in kept if x)


def _packed(batches):
    """Strings of a shard that stand near one another, up to PACK_PAGES, packed together: what they share is held once."""
    for batch in batches:
        ids, urls, hosts, shards = (batch.column(i).to_pylist() for i in range(4))
        held: dict[tuple, list] = {}
        for i, at in enumerate(zip(hosts, shards)):
            held.setdefault(at, []).append(i)
        for (host, shard), rows in held.items():
            for a in range(0, len(rows), PACK_PAGES):
                some = rows[a:a + PACK_PAGES]
                texts = [(batch.column(4)[i].as_py() or "").encode() for i in some]
                yield ([ids[i] for i in some], [urls[i] for i in some], host, shard, [len(x) for x in texts],
                       _LENGTH.pack(sum(map(len, texts))) + _CODEC.compress(b"".join(texts), asbytes=True))


def _unpacked(packed: bytes, sizes: list[int]):
    held, at = _CODEC.decompress(packed[_LENGTH.size:], _LENGTH.unpack_from(packed)[0], asbytes=True), 0
    for n in sizes:
        yield held[at:at + n].decode()
        at += n


_LENGTH = struct.Struct("<q")
_CODED = struct.Struct("<qB")


def coded(values: np.ndarray, bits: int = 64) -> bytes:
    """Sorted numbers below 2 ** ``bits``: the low bits of each as they are, the high ones as steps of a bitmap.

    n numbers take some n * (bits - log2(n) + 2) bits.
    """
    n = len(values)
    low = bits - n.bit_length() if n else 0
    low = max(low, 0)
    steps = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(steps[-1]) + 1 if n else 0, np.uint8)
    high[steps] = 1
    width = -(-low // 8)
    each = values.astype(">u8").view(np.uint8).reshape(n, 8)[:, 8 - width:]
    below = np.unpackbits(each, axis=1)[:, 8 * width - low:] if low else np.zeros((n, 0), np.uint8)
    return _CODED.pack(n, low) + np.packbits(below).tobytes() + np.packbits(high).tobytes()


def decoded(held: bytes) -> np.ndarray:
    n, low = _CODED.unpack_from(held)
    raw = np.frombuffer(held, np.uint8, offset=_CODED.size)
    cut = -(-n * low // 8)
    steps = np.flatnonzero(np.unpackbits(raw[cut:]))[:n]
    high = (steps - np.arange(n)).astype(np.uint64) << np.uint64(low)
    width = -(-low // 8)
    each = np.zeros((n, 8 * width), np.uint8)
    each[:, 8 * width - low:] = np.unpackbits(raw[:cut], count=n * low).reshape(n, low)
    whole = np.zeros((n, 8), np.uint8)
    if low:
        whole[:, 8 - width:] = np.packbits(each, axis=1)
    return high | whole.view(">u8").ravel().astype(np.uint64)


def _read_pages(batches):
    """Pages as they are read from their html, packed; with the shards of their host."""
    for batch in batches:
        read = pa.array([Page(x.as_py() or "").dumps() for x in batch.column(4)], pa.large_string())
        of = dict(zip(batch.column(2).to_pylist(), batch.column(5).to_pylist()))
        for row in _packed([pa.record_batch([*batch.columns[:4], read], names=batch.schema.names[:5])]):
            yield *row, of[row[2]]


def _pages_of(t: pa.Table) -> tuple[list, list, list[Page]]:
    """Ids, addresses and pages of a shard, in the order of the ids."""
    ids, urls = ([x for some in t.column(c).to_pylist() for x in some] for c in ("page_ids", "urls"))
    pages = [Page.loads(x) for packed, sizes in zip(t.column("packed").to_pylist(), t.column("sizes").to_pylist())
             for x in _unpacked(packed, sizes)]
    order = _in_order(ids)
    return [ids[i] for i in order], [urls[i] for i in order], [pages[i] for i in order]


def _by_bucket(values: np.ndarray, shards: int) -> list[np.ndarray]:
    """The places of the values of each bucket of a host with so many shards."""
    buckets = -(-shards // BUCKET_SHARDS)
    at = (values % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    return np.split(order, np.searchsorted(at[order], np.arange(1, buckets)))


def _first_bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes >> np.uint64(64 - bits)


def _telling_bits(hashes: np.ndarray) -> int:
    """How many first bits tell sorted, distinct hashes from one another."""
    return 65 - int((hashes[1:] ^ hashes[:-1]).min()).bit_length() if len(hashes) > 1 else 1


def _run_marks(t: pa.Table):
    """(host, bucket, shard, rows, prints, blocks, pages) of a shard, a row per bucket of its host, even if it has nothing there.

    Prints are those of all runs, none for a host with one shard; blocks come
    with the number of rows that they stand on.
    """
    host, shard, shards = (t.column(c)[0].as_py() for c in ("host", "shard", "shards"))
    ids, _, pages = _pages_of(t)
    hashes = np.zeros(0, np.uint64)
    if shards > 1:
        hashes = np.unique(_runs_of(*_words_of(pages, ids))[1])
    found = [h for p in pages for h in {block_hash(text) for text, e in p.blocks if not p.chrome[e] and _is_run(text)}]
    blocks, on = np.unique(np.array(found, np.int64).view(np.uint64), return_counts=True)
    for b, (mine, some) in enumerate(zip(_by_bucket(hashes, shards), _by_bucket(blocks, shards))):
        yield (host, b, shard, len(ids), coded(np.unique(_first_bits(hashes[mine], PRINT_BITS)), PRINT_BITS), coded(blocks[some]),
               _CODEC.compress(on[some].astype("<u4").tobytes(), asbytes=True))


def _repeated(parts: list[np.ndarray]) -> list[np.ndarray]:
    """Which numbers of each part, distinct in it, stand in another part too."""
    values = np.concatenate(parts)
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    many = np.zeros(len(values), bool)
    many[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(values) else False
    return np.split(many, np.cumsum([len(x) for x in parts])[:-1])


def _wanted(t: pa.Table):
    """(host, shard, bucket, prints, notices): prints that stand in several shards, to each of these, and the host's notices."""
    host, bucket = (t.column(c)[0].as_py() for c in ("host", "bucket"))
    shards, rows = t.column("shard").to_pylist(), sum(t.column("rows").to_pylist())
    prints = [decoded(x) for x in t.column("runs").to_pylist()]
    blocks = [decoded(x) for x in t.column("blocks").to_pylist()]
    on = [np.frombuffer(_CODEC.decompress(x, 4 * len(b), asbytes=True), "<u4") for x, b in zip(t.column("pages").to_pylist(), blocks)]
    value, place = np.unique(np.concatenate(blocks), return_inverse=True)
    pages = np.bincount(place, np.concatenate(on), len(value))
    notices = value[(pages >= NOTICE_PAGES) & (pages > NOTICE_SHARE * rows)]
    for shard, x, many in zip(shards, prints, _repeated(prints)):
        if len(notices) or many.any():
            yield host, shard, bucket, coded(x[many], PRINT_BITS), coded(notices)


def _candidates(t: pa.Table, wanted: pa.Table):
    """(host, bucket, shard, runs, bits, notices): whole hashes of the runs of a shard whose prints are wanted.

    So many first bits tell all its runs in the bucket from one another; notices pass.
    """
    if not (t.num_rows and wanted.num_rows):
        return
    host, shard, shards = (t.column(c)[0].as_py() for c in ("host", "shard", "shards"))
    prints = [decoded(x) for x in wanted.column("runs").to_pylist()]
    hashes = np.zeros(0, np.uint64)
    if any(map(len, prints)):
        ids, _, pages = _pages_of(t)
        hashes = np.unique(_runs_of(*_words_of(pages, ids))[1])
    places = _by_bucket(hashes, shards)
    for b, x, notices in zip(wanted.column("bucket").to_pylist(), prints, wanted.column("notices").to_pylist()):
        mine = hashes[places[b]]
        yield host, b, shard, coded(mine[np.isin(_first_bits(mine, PRINT_BITS), x)]), _telling_bits(mine), notices


def _confirmed(t: pa.Table):
    """(host, shard, bucket, runs, bits, notices): first bits of the runs that stand in several shards, to each of these."""
    host, bucket = (t.column(c)[0].as_py() for c in ("host", "bucket"))
    runs = [decoded(x) for x in t.column("runs").to_pylist()]
    shards, bits, notices = (t.column(c).to_pylist() for c in ("shard", "bits", "notices"))
    for shard, x, many, n, notice in zip(shards, runs, _repeated(runs), bits, notices):
        if many.any() or len(decoded(notice)):
            yield host, shard, bucket, coded(_first_bits(x[many], n), n), n, notice


def _told(back: pa.Table, shards: int) -> Callable | None:
    """A function that tells which of the hashes of a shard's runs came back, if any did."""
    rows = [(b, n, decoded(x)) for b, n, x in zip(*(back.column(c).to_pylist() for c in ("bucket", "bits", "runs")))]
    if not any(len(x) for _, _, x in rows):
        return None

    def told(hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), bool)
        places = _by_bucket(hashes, shards)
        for b, n, x in rows:
            out[places[b]] = np.isin(_first_bits(hashes[places[b]], n), x)
        return out
    return told


def _shard_rows(t: pa.Table, back: pa.Table):
    if not t.num_rows:
        return
    notices = frozenset(h for x in back.column("notices").to_pylist() for h in decoded(x).view(np.int64).tolist())
    ids, urls, pages = _pages_of(t)
    texts = shard_texts(pages, ids, _told(back, t.column("shards")[0].as_py()), notices)
    for page_id, url, text in zip(ids, urls, texts):
        yield page_id, url, text, len(text)


def _by_group(fn, ddl: str):
    """A function from the tables of a group to row tuples, as ``applyInArrow`` takes it."""
    schema = arrow_schema(ddl)

    def of_one(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches(rebatch(fn(t), schema), schema)

    def of_two(t: pa.Table, other: pa.Table) -> pa.Table:
        return pa.Table.from_batches(rebatch(fn(t, other), schema), schema)
    return of_two if fn.__code__.co_argcount == 2 else of_one


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def main_texts(pages: DataFrame, shard_pages: int = SHARD_PAGES, shard_bytes: int = SHARD_BYTES,
               broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    Blocks are joined in page order by one space.  A null, empty or broken
    html gives what its visible text gives, in the extreme an empty text; a
    null url or one without a host counts to one nameless host.  Rows of one
    page_id are one page for the repeats, and each gets its row.  An empty
    table gives no rows.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html"))
    hosts = p.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("html").cast("long")).alias("bytes"))
    hosts = hosts.select("host", F.greatest(
        F.ceil(F.col("n") / shard_pages), F.ceil(F.coalesce("bytes", F.lit(0)) / shard_bytes)).cast("int").alias("shards"))
    many = materialize(hosts.filter("shards > 1"))
    if many.count() <= broadcast_hosts:
        many = F.broadcast(many)
    shards = F.coalesce("shards", F.lit(1))
    dealt = p.join(many, "host", "left").select(
        "page_id", "url", "host", F.pmod(F.xxhash64("page_id"), shards).cast("int").alias("shard"), shards.alias("shards"), "html")
    read = map_rows(dealt.select("page_id", "url", "host", "shard", "html", "shards"), _read_pages,
                    "page_ids array<long>, urls array<string>, host string, shard int, sizes array<int>, packed binary, shards int")
    # One shuffle, read by all three: the plan reuses it as long as they take the same columns.
    met = read.repartition("host", "shard").groupBy("host", "shard")

    def each(grouped, fn, ddl):
        return grouped.applyInArrow(_by_group(fn, ddl), ddl)
    python_path(pages.sparkSession)
    marks = each(met, _run_marks, "host string, bucket int, shard int, rows long, runs binary, blocks binary, pages binary")
    wanted = each(marks.groupBy("host", "bucket"), _wanted, "host string, shard int, bucket int, runs binary, notices binary")
    sent = each(met.cogroup(wanted.groupBy("host", "shard")), _candidates,
                "host string, bucket int, shard int, runs binary, bits int, notices binary")
    back = each(sent.groupBy("host", "bucket"), _confirmed,
                "host string, shard int, bucket int, runs binary, bits int, notices binary")
    return each(met.cogroup(back.groupBy("host", "shard")), _shard_rows, "page_id long, url string, text string, n_chars long")
