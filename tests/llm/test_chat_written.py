"""Written chat examples against a plain version in Python."""

import hashlib
import random

from pyspark.sql import functions as F

from modelwatch.llm import chat, queries


def plain_escape(text):
    text = text.replace("\\", "\\\\")
    for c in chat.CONTROL:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def rows_of(rng):
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<\\s>", " ", "\n", "é", "x", "東", " [/INST] "]
    rows = []
    for conv in range(30):
        for turn in range(rng.randrange(1, 200 if conv == 0 else 9)):
            role = rng.choice(["user", "assistant", "system"])
            rows.append((conv, turn, role, "".join(rng.choice(parts) for _ in range(rng.randrange(9)))))
    rows += [(40, 0, "user", "u"), (40, 1, "assistant", "long " * 40_000), (40, 2, "assistant", "z" * 70_000), (40, 3, "user", "")]
    rows += [(41, 0, "assistant", "same")] * 300 + [(41, None, None, None)] * 300  # repeated rows, null turns
    rows += [(42, 0, "user", "nobody answers"), (None, 1, "assistant", "no id"), (None, None, "user", None)]
    return rows


def test_everything_is_read_back_from_written_examples(spark):
    rows = rows_of(random.Random(9))
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS place", "2 AS piece")
    formatted = chat.format_conversations(turns)
    written, got = chat.example_texts(formatted).collect(), chat.read_examples(formatted).collect()
    want, examples = {}, {}
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    for conv, ts in by_conv.items():
        stream, chars, loss = "", 0, ""
        for _, role, text in sorted(ts):
            head, body = chat.OPEN + plain_escape(role) + chat.HEADER_END, plain_escape(text)
            if role == "assistant":
                examples.setdefault(conv, []).append((stream + head, body))
                chars, loss = chars + len(stream + head + body + chat.CLOSE), loss + text
            stream += head + body + chat.CLOSE
        lines = "".join(f"{role}\n{text}\n" for _, role, text in sorted(ts))
        want[conv] = (len(ts), lines, loss, chars)
    assert {r.conv_id: (r.n_turns, r.lines, r.loss, r.formatted_chars) for r in got} == want and len(got) == len(want)
    found = {}
    for r in sorted(written, key=lambda r: r.target_start):
        found.setdefault(r.conv_id, []).append((r.context, r.target))
    assert found == examples
    chunks = formatted.filter("conv_id = 41").collect()
    assert all(len(r.stream) < chat.CHUNK_CHARS + 100 for r in chunks)
    assert formatted.filter("conv_id = 40").count() > 1
    assert chat.read_examples(formatted.limit(0)).count() == 0


def test_query_digests_equal_a_plain_version(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = {r.conv_id: r for r in queries.op9_chat(spark, sf_dir).collect()}
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn", "role", "text").collect()
    lines, loss = {}, {}
    for r in turns:
        lines.setdefault(r.conv_id, []).append(f"{r.role}\n{r.text or ''}\n")
        loss.setdefault(r.conv_id, []).append((r.text or "") if r.role == "assistant" else "")
    text = queries.CONTROL_TEXT
    lines[-1], loss[-1] = [f"user\n{text}\n", f"assistant\n{text}\n"], [text]
    assert got.keys() == lines.keys()
    for conv, r in got.items():
        said = "".join(loss[conv])
        assert (r.n_turns, r.loss_chars) == (len(lines[conv]), len(said))
        assert r.turns_sha256 == hashlib.sha256("".join(lines[conv]).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_turns_are_shuffled_once(spark, capsys):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        queries.op9_chat(spark, "/root/testdata/sf0.001").explain("formatted")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    tree = capsys.readouterr().out.split("\n\n(1)")[0]
    assert tree.count("Exchange (") - tree.count("ReusedExchange (") == 1 and "Python" not in tree
