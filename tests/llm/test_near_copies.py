"""The near-copy stage on ids that are null or repeat."""

import corpus_pipeline


def test_each_group_keeps_one_document(make):
    base = [" ".join(f"g{g}w{i}" for i in range(40)) for g in range(5)]
    docs = [
        (1, base[0]), (2, base[0] + " more"),
        # One id, a near copy and a text without any.
        (2, "a clean text of its own"),
        # The id that goes in the group above names this one.
        (2, base[1]), (9, base[1] + " more"),
        # Ids that are null in part, and in all.
        (None, base[2] + " more"), (7, base[2]),
        (None, base[3]), (None, base[3] + " more"),
        # One id for a whole group.
        (5, base[4]), (5, base[4] + " more"), (5, base[4] + " again"),
        # Without words; nothing links them.
        (20, ""), (20, " "), (None, None),
    ]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(None, make(docs), "").collect()]
    assert set(got) <= set(docs) and len(got) == len(set(got)) == 9
    assert {(1, base[0]), (2, base[1]), (2, "a clean text of its own"), (7, base[2]), (20, ""), (20, " "), (None, None)} <= set(got)
    for g in range(5):
        assert sum((text or "").startswith(base[g]) for _, text in got) == 1
