import random

import numpy as np

from parlance.llm import main_text as mt

PAGES = "page_id long, url string, html string"


def _page(rng, k, marked=True):
    words = lambda n: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))
    body = f"<h1>{words(4)}</h1><p><b>{words(9)}.<br>{words(15)} &amp; {words(15)}</p>"
    text = " ".join(body.replace("<h1>", "").replace("</h1>", " ").replace("<p>", "").replace("<b>", "")
                    .replace("<br>", " ").replace("</p>", "").replace("&amp;", "&").split())
    inner = f"<article>{body}</article>" if marked else f"<div>{body}</div>"
    html = (f"<!DOCTYPE html><html><head><title>t {k}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>"
            "<nav><ul><li><a href='/x'>Home</a></li><li>About us all</li></ul></nav><!-- ad --><div class='ad'>Buy this now</div>"
            + ("" if marked else "<div>Welcome to the site of all the news that fits</div>")
            + inner + "<div id='comments-3'><p>nice one</p></div><footer>&copy; host</footer>")
    return html, text


def test_covered_words_equal_brute_force():
    rng = random.Random(2)
    for _ in range(30):
        pages = [[rng.randrange(4) for _ in range(rng.randint(0, 14))] for _ in range(4)]
        words = np.array([w for p in pages for w in p], np.int64)
        owner = np.array([i for i, p in enumerate(pages) for _ in p], np.int64)
        for depth in (1, 2, 3, 5, 6):
            want = []
            for i, p in enumerate(pages):
                hit = [False] * len(p)
                for a in range(len(p) - depth + 1):
                    run = p[a:a + depth]
                    if any(q[b:b + depth] == run for j, q in enumerate(pages) if j != i for b in range(len(q) - depth + 1)):
                        hit[a:a + depth] = [True] * depth
                want += hit
            assert mt.covered_words(words, owner, depth).tolist() == want


def test_article_is_kept_whole_even_if_repeated(spark):
    rng = random.Random(1)
    made = [_page(rng, k) for k in range(20)]
    rows = [(k, f"http://h.example/{k}", made[k][0]) for k in range(20)]
    rows += [(100, "http://h.example/copy", made[0][0]), (101, "http://alone.example/", made[1][0]), (0, rows[0][1], rows[0][2])]
    want = {k: made[k][1] for k in range(20)} | {100: made[0][1], 101: made[1][1]}
    df = spark.createDataFrame(rows, PAGES)
    for options in ({}, {"shard_pages": 3}, {"shard_pages": 3, "broadcast_hosts": 0}):
        got = mt.main_texts(df, **options).collect()
        assert len(got) == len(rows)
        assert all(r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"]) for r in got)


def test_repeats_leave_unmarked_pages():
    rng = random.Random(4)
    made = [_page(rng, k, marked=False) for k in range(6)]
    texts = mt.shard_texts([mt.Page(h) for h, _ in made], list(range(6)))
    assert texts == [t for _, t in made]


def test_broken_and_empty_pages(spark):
    rows = [(1, None, None), (2, "x", ""), (3, None, "<p>a &lt;b&gt; c < d<p>e"), (4, "http://h/", "<div hidden>n</div>z<!-- "),
            (5, "http://h/", "<script>never closed"), (None, "http://h/", "<p>q")]
    got = {r["page_id"]: r["text"] for r in mt.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {1: "", 2: "", 3: "a <b> c < d e", 4: "z", 5: "", None: "q"}
    assert mt.main_texts(spark.createDataFrame([], PAGES)).count() == 0


def test_repeats_of_a_host_do_not_depend_on_its_shards(spark):
    rng = random.Random(6)
    notice = "this site was moved to another address in the spring of last year"
    word = lambda: f"w{rng.randrange(10 ** 6)}"
    own = {k: " ".join(word() for _ in range(40)) for k in range(60)}
    html = {k: f"<body><div>{t}<p>{notice}</p></div></body>" if k % 20 == 0 else f"<body><div>{t}</div></body>"
            for k, t in own.items()}
    rows = [(k, f"http://h.example/{k}", h) for k, h in html.items()] + [(0, "http://h.example/0", html[0])]
    df = spark.createDataFrame(rows, PAGES)
    for options in ({}, {"shard_pages": 2}, {"shard_pages": 2, "broadcast_hosts": 0}, {"shard_pages": 1}):
        got = mt.main_texts(df, **options).collect()
        assert len(got) == len(rows) and all(r["text"] == own[r["page_id"]] for r in got)


def test_a_piece_of_a_name_hides_no_article():
    text = "one two three four five six seven eight nine ten"
    aside = "<div class='sidebar'>buy this now</div><div class='site-footer'>all rights</div>"
    comments = "<div class='comments'><article class='comment'>nice one</article></div>"
    pages = [f"<body><div class='content with-sidebar'><article>{text}</article>{comments}</div>{aside}</body>",
             f"<body><div class='has-nav row'><article>{text}</article></div>{aside}</body>",
             f"<body><article class='post category-notices'>{text}</article>{aside}</body>",
             f"<body><article><div class='entry-header'>{text[:8]}</div>{text[8:]}<div class='share'>post it</div></article>{aside}</body>",
             f"<body><div class='overlay'><article>{text}</article></div>{aside}</body>",
             f"<body><div class='page-with-sidebar'><p>{text}</p></div>{aside}</body>"]
    for html in pages:
        assert mt.shard_texts([mt.Page(html)], [0]) == [" ".join(text.split())]


def test_copies_of_an_unmarked_page_keep_their_text(spark):
    rng = random.Random(8)
    words = lambda n: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))
    notice = "all that is said here was said by others long before us"
    copied = f"{words(30)}"
    pages = {k: (f"<body><div><p>{t}</p><p>{notice}</p></div></body>", t) for k, t in
             [(1, copied), (2, copied)] + [(k, words(40)) for k in range(3, 12)]}
    rows = [(k, f"http://h.example/{k}", h) for k, (h, _) in pages.items()]
    df = spark.createDataFrame(rows + [(100, "http://two.example/a", pages[1][0]), (101, "http://two.example/b", pages[1][0])], PAGES)
    want = {k: t for k, (_, t) in pages.items()} | {100: f"{copied} {notice}", 101: f"{copied} {notice}"}
    for options in ({}, {"shard_pages": 2}, {"shard_pages": 1}):
        assert {r["page_id"]: r["text"] for r in mt.main_texts(df, **options).collect()} == want


def test_all_articles_of_a_page_stay():
    for outer in ("main", "body"):
        html = f"<{outer}><article>one two</article><article>three four five six</article></{outer}>"
        assert mt.shard_texts([mt.Page(html)], [0]) == ["one two three four five six"]
    html = "<body><main><p>menu here</p><article>a b c d e f <article>g h</article></article><article>i j k l</article></main></body>"
    assert mt.shard_texts([mt.Page(html)], [0]) == ["a b c d e f g h i j k l"]


def test_notices_inside_articles_go_and_shared_passages_stay(spark):
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))
    notice, passage = "this page may not be copied without our leave", words(25)
    own = {k: words(40) for k in range(30)}
    html = {k: f"<article><p>{t}</p>{f'<p>{passage}</p>' if k < 12 else ''}<p>{notice}</p></article>" for k, t in own.items()}
    want = {k: f"{t} {passage}" if k < 12 else t for k, t in own.items()}
    rows = [(k, f"http://h.example/{k}", h) for k, h in html.items()]
    # A host that is one page many times keeps it.
    rows += [(1000 + k, "http://same.example/", html[0]) for k in range(8)]
    want |= {1000 + k: f"{own[0]} {passage} {notice}" for k in range(8)}
    df = spark.createDataFrame(rows, PAGES)
    for options in ({}, {"shard_pages": 4}, {"shard_pages": 4, "broadcast_hosts": 0}):
        assert {r["page_id"]: r["text"] for r in mt.main_texts(df, **options).collect()} == want


def test_coded_numbers_come_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        x = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False))
        assert (mt.decoded(mt.coded(x)) == x).all() and len(mt.decoded(mt.coded(x))) == len(x)


def test_the_suffix_array_sees_the_words_of_articles():
    """Two articles share a part whose name has a piece of a menu's; what they say themselves differs."""
    rng = random.Random(10)
    words = lambda n: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))
    shared, own = words(8), [words(30) for _ in range(3)]
    part = f"<div class='more-related'>{shared}</div>"
    pages = [mt.Page(f"<article><p>{own[0]}</p>{part}</article>"), mt.Page(f"<article><p>{own[1]}</p>{part}</article>")]
    assert mt.shard_texts(pages, [0, 1]) == own[:2]
    # Nobody else says it: it stays.
    alone = mt.Page(f"<article><p>{own[2]}</p><div class='more-related'>{words(8)}</div></article>")
    assert len(mt.shard_texts([alone], [2])[0].split()) == 38


def test_pages_that_are_packed_together_come_back():
    import pyarrow as pa
    html = ["<p>a</p>", None, "", "<p>é中</p>"] * 40
    n = len(html)
    batch = pa.record_batch([pa.array(range(n)), pa.array(["u"] * n), pa.array(["h"] * n), pa.array([0] * n, pa.int32()), pa.array(html)],
                            names=["page_id", "url", "host", "shard", "html"])
    got = [(i, x) for ids, _, _, _, sizes, packed in mt._packed([batch]) for i, x in zip(ids, mt._unpacked(packed, sizes))]
    assert got == [(i, x or "") for i, x in enumerate(html)]


def _grouped(rows, names, keys):
    """The tables of each group of row tuples, as Spark hands them over."""
    import pyarrow as pa
    groups: dict = {}
    for r in rows:
        groups.setdefault(tuple(r[names.index(k)] for k in keys), []).append(r)
    return {k: pa.table({n: [r[i] for r in some] for i, n in enumerate(names)}) for k, some in groups.items()}


def _rounds(pages, shards):
    """The rounds in which the runs of a host's shards meet: rows of the first, hashes that come back, by shard."""
    import pyarrow as pa
    rows = []
    for i, html in pages.items():
        batch = pa.record_batch([pa.array([i]), pa.array(["u"]), pa.array(["h"]), pa.array([i % shards], pa.int32()), pa.array([html]),
                                 pa.array([shards], pa.int32())], names=["page_id", "url", "host", "shard", "html", "shards"])
        rows += mt._read_pages([batch])
    met = _grouped(rows, ["page_ids", "urls", "host", "shard", "sizes", "packed", "shards"], ["host", "shard"])
    marks = [r for t in met.values() for r in mt._run_marks(t)]
    buckets = _grouped(marks, ["host", "bucket", "shard", "rows", "runs", "blocks", "pages"], ["host", "bucket"])
    wanted = _grouped([r for t in buckets.values() for r in mt._wanted(t)], ["host", "shard", "bucket", "runs", "notices"], ["host", "shard"])
    sent = [r for k, t in met.items() if k in wanted for r in mt._candidates(t, wanted[k])]
    sent = _grouped(sent, ["host", "bucket", "shard", "runs", "bits", "notices"], ["host", "bucket"])
    names = ["host", "shard", "bucket", "runs", "bits", "notices"]
    back = _grouped([r for t in sent.values() for r in mt._confirmed(t)], names, ["shard"])
    out = {}
    for s, runs in _runs_by_shard(pages, shards).items():
        told = mt._told(back[s,], shards) if (s,) in back else None
        hashes = np.array(sorted(runs), np.uint64)
        out[s] = set(hashes[told(hashes)].tolist()) if told else set()
    return marks, out


def _runs_by_shard(pages, shards):
    out = {s: set() for s in range(shards)}
    for i, html in pages.items():
        words = np.array([mt._word_hash(x) for text, _ in mt.Page(html).blocks for x in text.split(" ")], np.uint64)
        out[i % shards] |= {int(h) for h in mt.run_hashes(words)}
    return out


def test_only_runs_of_several_shards_come_back_however_short_the_prints(monkeypatch):
    rng = random.Random(12)
    words = lambda n: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))
    passage = [words(9) for _ in range(4)]
    pages = {i: f"<p>{words(30)}</p><p>{passage[i // 2 % 4] if i % 3 else ''}</p>" for i in range(40)}
    for shards in (1, 2, 5, 9):
        runs = _runs_by_shard(pages, shards)
        want = {s: {h for h in x if any(h in y for t, y in runs.items() if t != s)} for s, x in runs.items()}
        assert shards < 2 or any(want.values())
        for bits in (2, 7, 28):
            monkeypatch.setattr(mt, "PRINT_BITS", bits)
            assert _rounds(pages, shards)[1] == want


def test_runs_that_stand_once_cost_two_bytes_each():
    rng = random.Random(13)
    pages = {i: "<p>" + " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(2000)) + "</p>" for i in range(60)}
    marks, back = _rounds(pages, 6)
    n = sum(len(x) for x in _runs_by_shard(pages, 6).values())
    assert sum(len(x) for row in marks for x in row if isinstance(x, bytes)) < 2.5 * n
    assert not any(back.values())


def test_what_was_read_of_a_page_comes_back():
    rng = random.Random(14)
    sources = [_page(rng, 1)[0], _page(rng, 2, marked=False)[0], "", "<p>a&#10;b c&nbsp;d<li>é<div hidden>x</div>y",
               "<body><div class='has-nav'><main><article>a <p>b</article></main></div><div id='menu-2'>m</div>z"]
    for source in sources:
        a, b = mt.Page(source), mt.Page.loads(mt.Page(source).dumps())
        assert (a.blocks, a.parent, a.chrome, a.named) == (b.blocks, b.parent, b.chrome, b.named)
        assert [t in mt.ARTICLES for t in a.tag] == [t in mt.ARTICLES for t in b.tag]


def test_pages_are_read_and_shuffled_once(spark):
    rows = [(k, "http://h.example/", f"<p>one two three four five six seven {k}</p>") for k in range(20)]
    df = mt.main_texts(spark.createDataFrame(rows, PAGES), shard_pages=4)
    assert len(df.collect()) == 20
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 2 and plan.count("MapInArrow") == 1
