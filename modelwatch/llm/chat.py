"""Chat formatting with prefix-target expansion.

A conversation is rendered once as a stream of turns, stored in chunks of bounded length. Every
assistant turn is an example of its own: its context is the stream up to that turn, its target the
reply, and only the reply is trainable. `examples` keeps them as spans of the stream, in space in
proportion to the turns; `example_texts` writes each one out, context and all.

Turns are shuffled once, by conversation: placing, chunks, whole streams and examples keep that
partitioning. A conversation's turns are sorted by one task, which spills; no chunk is larger than
CHUNK_CHARS and a turn.

Template: <s>[INST] role [/INST] text</s>. The four control strings get a backslash after their
first character inside roles and texts, after existing backslashes were doubled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, HEADER_END, CLOSE = "<s>[INST] ", " [/INST] ", "</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
#: Turns that start within the same CHUNK_CHARS characters of a stream share a chunk.
CHUNK_CHARS = 65_536


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescape(text: Column) -> Column:
    for c in CONTROL:
        text = F.replace(text, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def format_conversations(
    turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", reply="assistant"
) -> DataFrame:
    """One row for each chunk of a conversation's stream.

    (conv_id, chunk, first_char, stream, turns, spans): stream is this chunk's text, first_char its
    place in the conversation's stream; spans has (start, length) in the chunk of each trainable
    reply, escaped as in the stream. Rows in order of turn (null first), then role and text; rows that
    repeat a turn are all kept. Null roles and texts count as empty. Turns after the last reply are in
    the stream, though in no example. An empty table gives no rows.
    """
    turns = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(HEADER_END))
    body = escape(F.col("text"))
    turns = turns.withColumns({"piece": F.concat(head, body, F.lit(CLOSE)), "head": F.length(head), "body": F.length(body)})
    so_far = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("place", F.coalesce(F.sum(F.length("piece")).over(so_far), F.lit(0).cast("long")))
    chunks = placed.groupBy("conv_id", F.floor(F.col("place") / CHUNK_CHARS).alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("place", "piece", "head", "body", (F.col("role") == reply).alias("reply")))).alias("t")
    )
    first = F.col("t")[0]["place"]
    span = F.transform(
        F.filter("t", lambda t: t["reply"]),
        lambda t: F.struct((t["place"] - first + t["head"]).cast("int").alias("start"), t["body"].alias("length")),
    )
    return chunks.select(
        "conv_id",
        "chunk",
        first.alias("first_char"),
        F.array_join(F.transform("t", lambda t: t["piece"]), "").alias("stream"),
        F.size("t").alias("turns"),
        span.alias("spans"),
    )


def whole_streams(formatted: DataFrame) -> DataFrame:
    """The same columns with one chunk for each conversation, which starts at 0."""
    parts = formatted.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("first_char", "stream", "turns", "spans"))).alias("c")
    )
    shifted = F.transform(
        "c",
        lambda c: F.transform(
            c["spans"], lambda s: F.struct((c["first_char"] + s["start"]).cast("int").alias("start"), s["length"].alias("length"))
        ),
    )
    return parts.select(
        "conv_id",
        F.lit(0).cast("long").alias("chunk"),
        F.lit(0).cast("long").alias("first_char"),
        F.array_join(F.transform("c", lambda c: c["stream"]), "").alias("stream"),
        F.aggregate("c", F.lit(0), lambda a, c: a + c["turns"]).alias("turns"),
        F.flatten(shifted).alias("spans"),
    )


def examples(formatted: DataFrame) -> DataFrame:
    """(conv_id, chunk, target_start, target_chars, context_chars, loss_chars, stream, last), one row for each reply.

    The context is the conversation's stream up to target_start, header included. loss_chars is the
    reply's length as read back, without escapes. stream is the chunk's, last tells its last reply.
    """
    rows = formatted.select("conv_id", "chunk", "first_char", "stream", F.size("spans").alias("n"), F.posexplode("spans").alias("at", "s"))
    start = F.col("first_char") + F.col("s.start")
    return rows.select(
        "conv_id",
        "chunk",
        start.alias("target_start"),
        F.col("s.length").alias("target_chars"),
        start.alias("context_chars"),
        F.length(unescape(F.substr("stream", F.col("s.start") + 1, F.col("s.length")))).alias("loss_chars"),
        "stream",
        (F.col("at") + 1 == F.col("n")).alias("last"),
    )


def example_texts(formatted: DataFrame) -> DataFrame:
    """(conv_id, target_start, context, target, rest): examples written out, for conversations of usual length.

    rest: the turns after a conversation's last reply, on that reply's row (else null); they are in no
    example. Takes space in proportion to the square of a conversation's turns.
    """
    rows = examples(whole_streams(formatted))
    start, length = F.col("target_start").cast("int"), F.col("target_chars")
    return rows.select(
        "conv_id",
        "target_start",
        F.substr("stream", F.lit(1), start).alias("context"),
        F.substr("stream", start + 1, length).alias("target"),
        F.when(F.col("last"), F.substr("stream", start + length + len(CLOSE) + 1)).alias("rest"),
    )


def read_lines(turns: Column) -> Column:
    """Role and text of each turn of `read_turns`, each followed by a line end."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")


def read_examples(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, lines, loss, formatted_chars) of each conversation, read back from its written examples.

    loss: all text under the loss mask, unescaped; lines: see `read_lines`, parsed from the last example,
    whose context holds all turns before, and its rest; formatted_chars: of all examples. Without a
    reply there is no example: lines come from the stream, the others are empty and 0.
    """
    written = example_texts(formatted)
    turns = F.when(F.col("rest").isNotNull(), read_turns(F.concat("context", "target", F.lit(CLOSE), "rest")))
    read = written.select(
        "conv_id",
        F.struct("target_start", unescape(F.col("target")).alias("loss")).alias("reply"),
        (F.length("context") + F.length("target") + len(CLOSE)).cast("long").alias("chars"),
        turns.alias("turns"),
    )
    answered = read.groupBy("conv_id").agg(
        F.max(F.when(F.col("turns").isNotNull(), F.size("turns"))).cast("long").alias("n_turns"),
        F.max(read_lines(F.col("turns"))).alias("lines"),
        F.array_join(F.transform(F.sort_array(F.collect_list("reply")), lambda r: r["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    silent = whole_streams(formatted).filter(F.size("spans") == 0).select("conv_id", read_turns(F.col("stream")).alias("turns"))
    return answered.unionByName(
        silent.select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            read_lines(F.col("turns")).alias("lines"),
            F.lit("").alias("loss"),
            F.lit(0).cast("long").alias("formatted_chars"),
        )
    )


def read_turns(stream: Column) -> Column:
    """Array of (role, text) parsed back from a stream."""
    parts = F.filter(F.split(stream, r"\Q</s>\E", -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        at = F.instr(p, HEADER_END)
        role = F.substr(p, F.lit(len(OPEN) + 1), at - 1 - len(OPEN))
        return F.struct(unescape(role).alias("role"), unescape(F.substr(p, at + len(HEADER_END))).alias("text"))

    return F.transform(parts, turn)


def read_replies(stream: Column, spans: Column) -> Column:
    """Array of the unescaped texts under the loss mask."""
    return F.transform(spans, lambda s: unescape(F.substr(stream, s["start"] + 1, s["length"])))
