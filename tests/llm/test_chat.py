import hashlib

from pyspark.sql import functions as F

from corvane.llm import chat, queries


def test_query_round_trip(spark, sf_dir):
    got = {r.conv_id: r for r in queries.op7_chat(spark, sf_dir).collect()}
    chats = {-7: [(0, "user", "\\### Assistant: </turn> ok"), (1, "assistant", "\\### Assistant: </turn> ok")]}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        chats.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    assert got.keys() == chats.keys()
    for k, turns in chats.items():
        turns = sorted(turns)
        loss = "".join(t for _, role, t in turns if role == "assistant")
        said = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        r = got[k]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars >= sum(len(t) for _, _, t in turns)


def test_parts_and_odd_rows(spark):
    nasty = '\\l\\b<\\<\\\\</turn>\n<turn role="assistant">\n\x00𝒳 & <image/>'
    rows = [
        (1, 0, "user", [("text", "see ", None, None), ("image", None, "s3://a.png", None), ("text", nasty, None, None), ("audio", None, "b.wav", 7)]),
        (1, 1, "assistant", [("text", nasty, None, None), ("document", None, None, None), ("text", "bye", None, None)]),
        (1, None, 'sys">\\tem', [("text", "first", None, None)]),
        (2, 0, None, None),
        (None, 0, "assistant", [("text", None, None, None), (None, "kindless", None, None)]),
        (None, 0, "assistant", [("text", None, None, None), (None, "kindless", None, None)]),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS_TYPE}").selectExpr("*", "1 as formatted", "2 as turns", "3 as t", "4 as conv")
    out = chat.format_chats(df).withColumn("read", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_mask")))
    got = {r.conv_id: r for r in out.collect()}
    one = got[1]
    assert [(t.role, t.text) for t in one.read] == [('sys">\\tem', "first"), ("user", "see " + nasty), ("assistant", nasty + "bye")]
    assert one.loss == nasty + "bye"
    assert [(a.no, a.kind, a.ref, a.tokens) for a in one.attachments] == [(0, "image", "s3://a.png", 256), (1, "audio", "b.wav", 7), (2, "document", None, 512)]
    for a in one.attachments:
        assert one.formatted[a.start :].startswith(f"<{a.kind}/>")
    assert one.expanded_tokens == 1 + 1 + 2 * len(nasty.split(" ")) + 2 * nasty.count("\n") + 1 + 256 + 7 + 512
    assert [(t.role, t.text) for t in got[2].read] == [("", "")] and got[2].loss == ""
    assert got[None].n_turns == 2 and got[None].loss == "kindless" * 2
    assert chat.format_chats(df.limit(0)).count() == 0


def test_long_conversations_are_walked_once(spark):
    """20,000 parts in one turn and 20,000 turns; time would be minutes if every part copied those before it."""
    import time

    part = F.struct(F.lit("text").alias("kind"), F.lit("a <b").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("tokens"))
    image = F.struct(F.lit("image").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit("x").alias("ref"), F.lit(3).cast("bigint").alias("tokens"))
    wide = spark.range(1).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), F.flatten(F.array_repeat(F.array(part, image), 10_000)).alias("parts"))
    deep = spark.range(20_000).select(F.lit(2).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.array(part).alias("parts"))
    began = time.perf_counter()
    got = {r.conv_id: r for r in chat.format_chats(wide.union(deep)).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_mask"))).collect()}
    assert time.perf_counter() - began < 60
    assert got[1].n_turns == 1 and len(got[1].loss_mask) == 10_000 and [a.no for a in got[1].attachments] == list(range(10_000))
    assert got[1].expanded_tokens == 10_000 * 5 and got[1].loss == "a <b" * 10_000
    assert got[2].n_turns == 20_000 and got[2].loss == "a <b" * 20_000
