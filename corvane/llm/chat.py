"""Chat formatting with typed content parts. DataFrame functions only.

A visitor turns each part of a message into output: text is escaped and written as it
is, an attachment (image, audio, document) becomes a numbered placeholder. The template
marks turns as ``<turn role="...">``, newline, content, ``</turn>``, newline. Within
texts ``\\`` is written ``\\b`` and ``<`` is written ``\\l`` (in roles also ``>`` and
``"`` as ``\\g`` and ``\\q``), so no text can hold a mark; the escapes are undone one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import word_count

#: The template's marks, and the tokens that a placeholder stands for where a part names none.
OPEN, SHUT = '<turn role="', "</turn>\n"
HEAD_END = '">\n'
TOKENS = {"image": 256, "audio": 150, "document": 512}

PARTS_TYPE = "array<struct<kind:string,text:string,ref:string,tokens:bigint>>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit(">"), F.lit("\\g")), F.lit('"'), F.lit("\\q"))


def _role_out(role: Column) -> Column:
    return unescaped(F.replace(F.replace(role, F.lit("\\g"), F.lit(">")), F.lit("\\q"), F.lit('"')))


def text_parts(text: Column) -> Column:
    """The parts of a message that is one plain text (null: empty)."""
    return F.array(
        F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("tokens"))
    ).cast(PARTS_TYPE)


def _segment(out: Column, loss: Column, kind: Column, ref: Column, tokens: Column) -> Column:
    return F.struct(out.alias("out"), loss.alias("loss"), kind.alias("kind"), ref.alias("ref"), tokens.alias("tokens"))


def _plain(out: Column) -> Column:
    return _segment(out, F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(0).cast("bigint"))


def _visit(part: Column, spoken: Column) -> Column:
    """Output of one part; ``spoken``: whether its text is under the loss mask."""
    is_text = F.coalesce(part["kind"], F.lit("text")) == "text"
    usual = F.create_map(*[x for k, v in TOKENS.items() for x in (F.lit(k), F.lit(v).cast("bigint"))])
    text = F.coalesce(part["text"], F.lit(""))
    return F.when(is_text, _segment(escaped(text), spoken, F.lit(None).cast("string"), F.lit(None).cast("string"), word_count(text))).otherwise(
        _segment(F.concat(F.lit("<"), _role_in(part["kind"]), F.lit("/>")), F.lit(False), part["kind"], part["ref"], F.coalesce(part["tokens"], F.try_element_at(usual, part["kind"]), F.lit(1).cast("bigint")))
    )


def format_chats(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", speaker: str = "assistant") -> DataFrame:
    """(conv, n_turns, formatted, loss_mask, attachments, expanded_tokens), one row per conversation.

    formatted: the turns in order of ``turn`` (null first; ties by role, then by parts).
    loss_mask: (start, chars) of each text of the speaker in the output, start from 0, in
    code points. attachments: (no, kind, ref, start, tokens) of each placeholder, in order,
    numbered from 0. expanded_tokens: words of the texts plus the placeholders' tokens.
    A null conversation is one like others; null roles, texts and parts are empty; repeated
    rows are turns of their own; no rows: no rows. A conversation is one output value, so its
    turns meet in one row.
    """
    turns = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(parts), F.array().cast(PARTS_TYPE)).alias("parts"))
    turns = turns.withColumn("turn_no", F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "parts")))
    head = _plain(F.concat(F.lit(OPEN), _role_in(F.col("role")), F.lit(HEAD_END)))
    body = F.transform("parts", lambda part: _visit(part, F.col("role") == speaker))
    segments = turns.select("conv", "turn_no", F.posexplode(F.concat(F.array(head), body, F.array(_plain(F.lit(SHUT))))).alias("no", "s"))
    # Places are running sums over the segments, so a conversation of any length is walked once.
    before = Window.partitionBy("conv").orderBy("turn_no", "no").rowsBetween(Window.unboundedPreceding, -1)
    chars = F.length("s.out").cast("bigint")
    placed = segments.select("conv", "turn_no", "no", "s", chars.alias("chars"), F.coalesce(F.sum(chars).over(before), F.lit(0)).alias("start"))
    span = F.when(F.col("s.loss"), F.struct("turn_no", "no", "start", "chars"))
    mark = F.when(F.col("s.kind").isNotNull(), F.struct("turn_no", "no", "start", F.col("s.kind").alias("kind"), F.col("s.ref").alias("ref"), F.col("s.tokens").alias("tokens")))
    chats = placed.groupBy("conv").agg(
        F.max("turn_no").cast("long").alias("n_turns"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn_no", "no", F.col("s.out").alias("out")))), lambda x: x["out"]), "").alias("formatted"),
        F.sort_array(F.collect_list(span)).alias("spans"),
        F.sort_array(F.collect_list(mark)).alias("marks"),
        F.sum("s.tokens").alias("expanded_tokens"),
    )
    spans = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["chars"].alias("chars")))
    marks = F.transform("marks", lambda x, i: F.struct(i.cast("bigint").alias("no"), x["kind"].alias("kind"), x["ref"].alias("ref"), x["start"].alias("start"), x["tokens"].alias("tokens")))
    return chats.select(F.col("conv").alias(conv), "n_turns", "formatted", spans.alias("loss_mask"), marks.alias("attachments"), "expanded_tokens")


def read_turns(formatted: Column) -> Column:
    """Turns read back from an output: array of (role, text), placeholders dropped, escapes undone."""
    cut = F.split(formatted, SHUT, -1)
    kept = F.slice(cut, F.lit(1), F.greatest(F.size(cut) - 1, F.lit(0)))

    def of(turn: Column) -> Column:
        end = F.position(F.lit(HEAD_END), turn)
        role = F.substring(turn, F.lit(len(OPEN) + 1), end - len(OPEN) - 1)
        body = F.substring(turn, end + len(HEAD_END), F.length(turn))
        return F.struct(_role_out(role).alias("role"), unescaped(F.regexp_replace(body, "<[^<>]*/>", "")).alias("text"))

    return F.transform(kept, of)


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under a loss mask, escapes undone, nothing between."""
    return F.array_join(F.transform(mask, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["chars"].cast("int")))), "")
