"""Late and back-dated rows of a streamed label join."""

import datetime as dt

from test_streams import stream, write_batches

from modelwatch.streaming import facts, labels

T0 = dt.datetime(2024, 1, 1)
P = "request_id int, event_time timestamp, prediction string"
LABELS = "request_id int, label int, available_at timestamp"


def test_three_micro_batches_with_back_dated_rows_equal_the_batch_join(spark, tmp_path):
    day = dt.timedelta(days=1)
    preds = [(i, T0 + (150 - 5 * (i % 30)) * day, "yes") for i in range(60)]
    labs = [(i, i % 2, T0 + (150 - 5 * (i % 30) + (i * 7) % 110 - 5) * day) for i in range(59, -1, -1) if i % 6]
    write_batches(spark, preds, P, str(tmp_path / "p"), 3)
    write_batches(spark, labs, LABELS, str(tmp_path / "l"), 3)
    out = str(tmp_path / "out")

    def run(state):
        sides = stream(spark, str(tmp_path / "p"), P), stream(spark, str(tmp_path / "l"), LABELS)
        facts.run_available(labels.store_label_join(*sides, out, str(tmp_path / state), 90))
        return sorted((r.request_id, r.label, r.available_at) for r in labels.read_label_join(spark, out).collect())

    times = {i: t for i, t, _ in preds}
    want = sorted((i, x, t) for i, x, t in labs if times[i] <= t <= times[i] + 90 * day)
    assert 20 < len(want) < 50
    assert run("state") == want
    assert run("other") == want  # micro-batches that are repeated replace what they wrote
    as_of = T0 + 200 * day
    closed = sorted(r.request_id for r in labels.unanswered(spark, out, as_of, 90).collect())
    joined = {i for i, _, _ in want}
    assert closed == sorted(i for i, t, _ in preds if i not in joined and t + 90 * day < as_of) and closed
