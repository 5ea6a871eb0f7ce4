"""Turns that read what earlier turns wrote, as a table and as a stream."""

import hashlib
import random

from pyspark.sql import functions as F

from tidelog.operators import chat

SCHEMA = "e string, turn bigint, kind string, text string, needle string, gate boolean"


def turns(seed=1):
    rng = random.Random(seed)
    words = ["blue", "Red ", "GREEN?", "answer", "", None, " ", "1", "a"]
    return [(e, t, rng.choice(["fact", "user", "user"]), rng.choice(words), rng.choice([None, None, "answer", "E"]), rng.choice([True, True, False, None])) for e in ("x", "y", None) for t in range(12)]


def by_loop(rows, k, keep):
    out, memory = {}, {}
    for e, t, kind, text, needle, gate in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2], r[3] or "")):
        own = memory.setdefault(e, [])
        if kind == "fact":
            own += [text] if text else []
        else:
            said, low = (text or "").strip(), (needle or (text or "").strip()).strip().lower()
            ranked = sorted(own, key=lambda x: low not in x.lower())[:k] if gate and said else []
            prompt = ("Memory:\n" + "".join(f"- {x}\n" for x in ranked) if ranked else "") + f"User: {said}"
            reply = '{"answer": "' + hashlib.md5(prompt.encode()).hexdigest()[:8] + '"}'
            out[e, t] = (reply, len(ranked))
            own += [x for x in (text, reply) if x]
        del own[:-keep]
    return out


def test_turns_against_a_loop(spark):
    for k, keep in ((4, 1000), (3, 5), (0, 5)):
        df = spark.createDataFrame(turns(), SCHEMA).repartition(5)
        got = {(r.e, r.turn): (r.reply, r.n_read) for r in chat.chat(df, entity="e", turn="turn", k=k, keep=keep).collect()}
        assert got == by_loop(turns(), k, keep)


def test_a_reply_changes_the_next_prompt(spark):
    rows = [("x", 0, "user", "one", None, True), ("x", 1, "user", "two", "answer", True)]
    a = {r.turn: r for r in chat.chat(spark.createDataFrame(rows, SCHEMA), entity="e", turn="turn").collect()}
    assert a[1].n_read == 2
    first = a[0].reply
    assert a[1].reply == '{"answer": "' + hashlib.md5(f"Memory:\n- {first}\n- one\nUser: two".encode()).hexdigest()[:8] + '"}'


def test_stream_gives_the_rows_of_the_table(spark, tmp_path):
    from tidelog.streaming import streams

    df = spark.createDataFrame(turns(2), SCHEMA)
    for third in range(3):
        df.where(F.floor(F.col("turn") / 4) == third).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = streams.read(spark, f"{tmp_path}/in", SCHEMA, files_per_trigger=1)
    put = streams.batches(f"{tmp_path}/out")
    stream = chat.chat_stream(source, entity="e", turn="turn", k=3, keep=7)
    for _ in range(2):
        streams.into(stream, put, f"{tmp_path}/checkpoint")
    got = sorted(str(tuple(r)) for r in spark.read.parquet(f"{tmp_path}/out").select("e", "turn", "reply", "n_read").collect())
    want = sorted(str(tuple(r)) for r in chat.chat(df, entity="e", turn="turn", k=3, keep=7).collect())
    assert got == want and len(got) > 10


def test_policies(spark):
    rows = [("x", None), ("what now", None), ("吗", " "), (None, None), ("x", "Question "), ("why?", "statement"), ("", "")]
    df = spark.createDataFrame(rows, "text string, kind string")
    got = {p: [r[0] for r in df.select(chat.should_retrieve(F.col("text"), F.col("kind"), p)).collect()] for p in ("always", "never", "question_only", "other")}
    assert got["always"] == got["other"] == [True, True, True, True, True, False, True]
    assert got["never"] == [False, False, False, False, True, False, False]
    assert got["question_only"] == [False, True, True, False, True, False, False]


def test_chat_of_nothing(spark):
    assert chat.chat(spark.createDataFrame([], SCHEMA), entity="e", turn="turn").collect() == []
