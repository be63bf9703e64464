"""Corpus vocabulary, fixed-length encoding with padding, decoding, truncation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import lower_tokens
from parlance.plans.ordering import broadcast_if_small, fetch_one, index_by_order, materialize

# Reserved ids.
PAD, BEGIN, END, UNKNOWN = 0, 1, 2, 3
SPECIALS = ["<pad>", "<s>", "</s>", "<unk>"]
MAX_TOKENS = 128
MAX_TOKENS_INCONTEXT = 512


def truncate(tokens, max_len: int = MAX_TOKENS, side: str = "tail") -> Column:
    """Keep at most ``max_len`` tokens.  side='tail' drops the end (HF
    truncation); side='head' drops the front (the prompt library's 'head')."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    if side == "tail":
        return F.slice(t, 1, max_len)
    if side == "head":
        return F.when(F.size(t) > max_len, F.slice(t, -max_len, max_len)).otherwise(t)
    raise ValueError(side)


def build_vocab(df: DataFrame, text: str = "text") -> DataFrame:
    """word, n, id: ids from 4 up by (count desc, word asc); a distributed
    dense index, never one task over the whole vocabulary."""
    counts = df.select(F.explode(lower_tokens(text)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    idx = index_by_order(counts, [F.desc("n"), F.asc("word")], "_i")
    return idx.select("word", "n", (F.col("_i") + len(SPECIALS)).cast("int").alias("id"))


def _vocabulary(vocab: DataFrame, cols) -> DataFrame:
    """The vocabulary's columns, broadcast if its counted rows are few enough."""
    return broadcast_if_small(vocab.select(*cols), fetch_one(vocab, n=F.count(F.lit(1)))["n"])


def encode_pad(docs: DataFrame, vocab: DataFrame, key: str = "m_idx", text: str = "text",
               max_len: int = MAX_TOKENS, keep=("par_id",)) -> DataFrame:
    """key, keep..., input_ids, attention_mask: <s> + the first max_len-2 token
    ids + </s>, right-padded to the longest sequence of the set (at most
    ``max_len``).  ``key`` is the unique position of a row.  Only kept
    positions are exploded, so a long text costs max_len rows."""
    toks = docs.select(key, *keep, F.posexplode_outer(F.slice(lower_tokens(text), 1, max_len - 2)).alias("pos", "word"))
    ids = toks.join(_vocabulary(vocab, ("word", "id")), "word", "left")
    place = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce(F.col("id"), F.lit(UNKNOWN)).alias("id")))
    seqs = ids.groupBy(key, *keep).agg(F.array_sort(F.collect_list(place)).alias("_s"))
    seq = F.concat(F.array(F.lit(BEGIN)), F.transform("_s", lambda s: s["id"]), F.array(F.lit(END)))
    # Sequences are at most max_len ints: write them once, then read twice.
    full = materialize(seqs.select(key, *keep, seq.alias("_q")))
    width = F.lit(fetch_one(full, w=F.max(F.size("_q")))["w"])
    pad = F.array_repeat(F.lit(PAD), width - F.size("_q"))
    return full.select(key, *keep, F.concat("_q", pad).alias("input_ids"),
                       F.concat(F.array_repeat(F.lit(1), F.size("_q")), F.array_repeat(F.lit(0), width - F.size("_q")))
                       .alias("attention_mask"))


def decode_ids(encoded: DataFrame, vocab: DataFrame, key: str = "m_idx", ids: str = "input_ids",
               skip_special: bool = True, keep=("par_id",)) -> DataFrame:
    """key, keep..., text: ids mapped back to words and joined by one space."""
    wanted = F.filter(ids, lambda i: ~i.isin(PAD, BEGIN, END)) if skip_special else F.col(ids)
    x = encoded.select(key, *keep, F.posexplode_outer(wanted).alias("pos", "id"))
    specials = F.create_map(*[v for i, s in enumerate(SPECIALS) for v in (F.lit(i), F.lit(s))])
    words = x.join(_vocabulary(vocab, ("id", "word")), "id", "left")
    place = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce(F.col("word"), specials[F.col("id")]).alias("word")))
    agg = words.groupBy(key, *keep).agg(F.array_sort(F.collect_list(place)).alias("_w"))
    return agg.select(key, *keep, F.array_join(F.transform("_w", lambda s: s["word"]), " ").alias("text"))
