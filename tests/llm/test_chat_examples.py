"""The chat query counts what the examples hold."""

import collections

from modelwatch.llm import chat, queries
from modelwatch.llm.common import table


def test_query_counts_the_dealt_examples(spark, monkeypatch):
    sf_dir, dealt = "/root/testdata/sf0.001", []
    examples = chat.examples
    monkeypatch.setattr(chat, "examples", lambda formatted: dealt.append(examples(formatted)) or dealt[-1])
    rows = {r.conv_id: r for r in queries.op9_chat(spark, sf_dir).collect()}
    assert len(dealt) == 1
    turns = table(spark, sf_dir, "conversations")
    whole, loss = collections.Counter(), collections.Counter()
    for r in chat.example_texts(chat.format_conversations(turns)).collect():
        whole[r.conv_id] += len(r.context) + len(r.target) + len(chat.CLOSE)
    for r in turns.filter("role = 'assistant'").collect():
        loss[r.conv_id] += len(r.text or "")
    assert rows.keys() == {r.conv_id for r in turns.select("conv_id").distinct().collect()} | {-1}
    for i, r in rows.items():
        if i != -1:
            assert (r.formatted_chars, r.loss_chars) == (whole[i], loss[i])
    control = rows[-1]
    assert control.loss_chars == len(queries.CONTROL_TEXT) and control.n_turns == 2
