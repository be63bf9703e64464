import random

from conftest import SF_SMALL
from parlance.llm import chat

PARTS = ["</s>", "[INST]", "\\", "\\\\", " ", "\n", "x", "[/INST]", "<<SYS>>", "<s>", "[", "INST]", "[ROLE]", "[ANS]", "é", ""]
ROLES = ["user", "assistant", "system", "tool", "a\nb", "\\", None, "", "[INST]", "\\n"]


def test_template_reads_back_and_spans_hold_the_texts():
    rng = random.Random(1)
    for _ in range(3000):
        turns = [(rng.choice(ROLES), "".join(rng.choices(PARTS, k=rng.randint(0, 8)))) for _ in range(rng.randint(0, 4))]
        out, spans, rewrites = chat.incremental(turns, chat.instruct_template)
        assert not rewrites and chat.read_back(out) == turns
        assert [chat.unescape(out[a:b]) for _, a, b, _ in spans] == [t for _, t in turns]
        assert [s for s, *_ in spans][1:] == [e for *_, e in spans][:-1]


def test_rewriting_template_is_detected():
    last_only = lambda turns: "".join(f"{r}:{t if i == len(turns) - 1 else '...'};" for i, (r, t) in enumerate(turns))
    out, spans, rewrites = chat.incremental([("u", "hello"), ("a", "there")], last_only)
    assert rewrites and out == "u:...;a:there;"
    assert [out[a:b] for _, a, b, _ in spans][-1] == "there"


def _shortening():
    """A template whose earlier answers keep their first three characters (made here, so that workers need no test module)."""
    return lambda turns: "".join(f"<{r}>{t if r != 'assistant' or i == len(turns) - 1 else t[:3]}</{r}>\n"
                                 for i, (r, t) in enumerate(turns))


SEVEN = [("system", "S"), ("user", "u1"), ("assistant", "answer one"), ("user", "u2"), ("assistant", "answer two"), ("user", "u3"),
         ("assistant", "answer three")]


def test_learnt_turns_stand_once_under_a_template_that_shortens_history():
    for n in range(1, 8):
        turns = SEVEN[:n]
        out, spans, rewrites = chat.incremental(turns, _shortening(), {"assistant"})
        assert rewrites == any(r == "assistant" for r, _ in turns[:-1]) and len(spans) == n
        said = [out[s[1]:s[2]] for s, (r, _) in zip(spans, turns) if r == "assistant"]
        assert said == [t if i == n - 1 else t[:3] for i, (r, t) in enumerate(turns) if r == "assistant"]


def test_rewriting_conversations_are_masked_or_refused(spark):
    df = spark.createDataFrame([(c, i, r, t) for c in (1, 2) for i, (r, t) in enumerate(SEVEN[:7 if c == 1 else 3])],
                               "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.formatted(df, _shortening()).collect()}
    texts = lambda r: [r["formatted"][m["from"]:m["to"]] for m in r["loss_mask"]]
    assert texts(got[1]) == ["ans", "ans", "answer three"] and got[1]["rewrites_history"] and not got[1]["refused"]
    assert texts(got[2]) == ["answer one"] and not got[2]["rewrites_history"] and not got[2]["refused"]
    dropping = lambda turns: "".join(f"{r}:{t};" for r, t in turns[-2:])
    r = {r["conv_id"]: r for r in chat.formatted(df, dropping).collect()}[1]
    assert r["rewrites_history"] and r["refused"] and r["loss_mask"] == []
    # A length that depends on the text leaves nothing around a marker as it was.
    counting = lambda turns: f"{sum(len(t) for _, t in turns)}:" + "".join(f"{r}:{t};" for r, t in turns)
    r = {r["conv_id"]: r for r in chat.formatted(df, counting).collect()}[1]
    assert r["rewrites_history"] and r["refused"] and r["loss_mask"] == []


def test_rows_without_a_conversation_stand_alone(spark):
    rows = [(None, i, "user", f"t{i}") for i in range(5)] + [(1, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = chat.formatted(df).collect()
    assert sorted(chat.read_back(r["formatted"]) for r in got if r["conv_id"] is None) == [[("user", f"t{i}")] for i in range(5)]


def test_conversations_with_nulls_ties_and_repeats(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (None, None, None, None),
            (2, None, "user", "x"), (2, 0, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as spans", "2 as t")
    got = {r["conv_id"]: r for r in chat.formatted(df).collect()}
    assert chat.read_back(got[1]["formatted"]) == [("user", ""), ("assistant", "b"), ("assistant", "b")]
    assert [got[1]["formatted"][m["from"]:m["to"]] for m in got[1]["loss_mask"]] == ["b", "b"]
    assert chat.read_back(got[None]["formatted"]) == [(None, "")]
    assert chat.read_back(got[2]["formatted"]) == [("user", "x"), ("user", "y")]
    assert chat.formatted(df.limit(0)).count() == 0


def test_long_conversation(spark):
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"turn {i} [INST]") for i in range(400)]
    r, = chat.digests(chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert r["n_turns"] == 400 and r["loss_chars"] == sum(len(t) for _, i, _, t in rows if i % 2)


def test_real_conversations_read_back(spark):
    df = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    want: dict = {}
    for r in df.orderBy("conv_id", "turn").collect():
        want.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    got = {r["conv_id"]: chat.read_back(r["formatted"]) for r in chat.formatted(df).collect()}
    assert got == want
