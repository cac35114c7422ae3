"""Links and streams of the n-gram join that single prefixes or batches do not show."""

import random

import pandas as pd
import pytest
from test_documents import brute_components

from modelwatch.llm import ngram_join


@pytest.mark.parametrize("most", [1, 4])
def test_truncated_and_extended_copies(make, most):
    """x, x with words appended (similarity 0.75 to 0.80) and x without its last words, in different tasks."""
    rng = random.Random(9)
    bases = [[f"g{g}w{i}" for i in range(104)] for g in range(60)]
    docs = [(g, " ".join(w)) for g, w in enumerate(bases)]
    docs += [(100 + g, " ".join(w + [f"g{g}a{i}" for i in range(rng.randrange(25, 34))])) for g, w in enumerate(bases)]
    docs += [(200 + g, " ".join(w + [f"g{g}b{i}" for i in range(33)])) for g, w in enumerate(bases)]
    docs += [(300 + g, " ".join(w[: -rng.randrange(1, 4)])) for g, w in enumerate(bases)]
    docs += [(400 + g, " ".join(w[rng.randrange(20, 26) :])) for g, w in enumerate(bases)]
    got = ngram_join.near_groups(make(docs), most_matches=most).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs)


@pytest.mark.parametrize("cut", range(1, 9))
def test_shared_in_batches_of_repeats(cut):
    """Batches that hold nothing but repeats of the last class of the batch before, whatever the cuts."""
    keys = [(1, 0, 0, 5)] + [(1, 0, 1, 6)] * 6 + [(2, 0, 0, 7)] * 4 + [(3, 1, 0, 8)] * 5 + [(4, 0, 0, 9), (4, 0, 0, 10)]
    rows = pd.DataFrame(keys, columns=["token", "run", "pos", "cls"]).assign(n=100, matches=1)
    batches = [rows.iloc[i : i + cut].reset_index(drop=True) for i in range(0, len(rows), cut)]
    out = pd.concat(ngram_join._shared(iter(batches)))
    got = list(out[["token", "cls", "hub_cls"]].itertuples(index=False, name=None))
    assert got == [(1, 5, 5), (1, 6, 5), (3, 8, 8), (4, 9, 9), (4, 10, 9)]
