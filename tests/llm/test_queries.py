"""The opN queries against DuckDB where SQL can express them, the pipeline against its operators, and odd tables."""

from collections import Counter

import pytest

import corpus_pipeline
from conftest import SF_SMALL
from helpers import DOCS, documents
from oracle import compare, duck
from parlance.llm import chat, embedding_dedup, language, main_text, mixing, near_dedup, pieces, quality, queries, secrets, warc


@pytest.mark.parametrize("name", sorted(queries.oracle()))
def test_query_equals_sql(spark, name):
    r = compare(spark, duck(SF_SMALL), name, queries.registered()[name], queries.oracle()[name], SF_SMALL)
    assert r["status"] == "exact", r


def test_every_operator_is_registered():
    numbers = sorted(int(k[2:].split("_")[0]) for k in queries.registered())
    assert numbers == list(range(1, 14))


def test_pipeline_stages_do_what_their_operators_say(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = lambda df: Counter(map(tuple, df.collect()))
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language_id", "near_dedup", "secret_scan", "mixing", "tokens"]

    seen = {r["doc_id"]: r for r in language.identify(docs).collect()}
    first = stage["language_id"](spark, docs, SF_SMALL)
    assert first.columns == docs.columns
    assert {r["doc_id"] for r in first.collect()} == {i for i, r in seen.items() if r["lang_pred"] != "und" and r["score"] >= 0.5}

    kept = {r["doc_id"] for r in near_dedup.near_duplicates(docs).filter("kept").collect()}
    second = stage["near_dedup"](spark, docs, SF_SMALL)
    assert rows(second) == rows(docs.filter(docs["doc_id"].isin(list(kept))))

    third = stage["secret_scan"](spark, docs, SF_SMALL).collect()
    spans = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(docs).collect()}
    assert all((secrets.MASK in r["text"]) == bool(spans[r["doc_id"]]) and r["n_chars"] == len(r["text"]) for r in third)

    taken = Counter({r["doc_id"]: r["taken"] // max(r["size"], 1) for r in mixing.mixture(docs).collect()})
    assert Counter(r["doc_id"] for r in stage["mixing"](spark, docs, SF_SMALL).collect()) == +taken

    back = pieces.decode_documents(stage["tokens"](spark, docs, SF_SMALL).select("doc_id", "ids"))
    assert rows(back) == rows(docs.select("doc_id", "text"))


CLASHING = ["rep", "node", "value", "key", "leader", "member", "digest", "rank", "copies", "target", "score", "spans", "_id", "_row",
            "words", "votes", "host", "shard", "payload", "length", "component"]
BY_DOCUMENT = {"near_duplicates": near_dedup.near_duplicates, "deduplicated": near_dedup.deduplicated,
               "mixture": mixing.mixture, "mixed_documents": mixing.mixed_documents, "identify": language.identify,
               "find_secrets": secrets.find_secrets, "mask_secrets": secrets.mask_secrets, "quality": quality.quality,
               "token_digests": pieces.token_digests, "encode_documents": pieces.encode_documents,
               "accepted": lambda d: language.accepted(d, language.train(d))}


@pytest.mark.parametrize("name", sorted(BY_DOCUMENT))
def test_nulls_extra_columns_and_empty_tables(spark, name):
    plain = spark.createDataFrame(documents(9) + [(None, None, None, None, None), (77, "x" * 200_000, None, None, 1)], DOCS)
    wide = plain.selectExpr("*", *[f"cast(7 as int) as `{c}`" for c in CLASHING])
    f = BY_DOCUMENT[name]
    a, b = f(plain), f(wide)
    common = a.columns
    key = lambda df: sorted(str(tuple(r)) for r in df.select(*common).collect())
    assert key(a) == key(b)
    assert f(wide.limit(0)).count() == 0


def test_extra_columns_elsewhere(spark):
    extra = [f"cast(7 as int) as `{c}`" for c in CLASHING if c not in ("host", "payload")]
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    vectors = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    talks = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    for df, f in ((pages, main_text.main_texts), (pages, warc.archived), (vectors, embedding_dedup.near_vectors),
                  (talks, chat.formatted)):
        a, b = f(df), f(df.selectExpr("*", *extra))
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
