"""Similarities of last tokens: blocks are not copied for their pairs, and tasks look the results up."""

import numpy as np
import pyarrow as pa
import pytest

from lexiframe.functions.sequences import last_known
from lexiframe.operators import embeddings as emb


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _table(spark, ids, m):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, m)], "id int, vec array<float>")


def test_last_ids_as_by_brute_force():
    rng = np.random.RandomState(5)
    contexts = [None, [], [0, 0], [None], [4, None], [None, 4, 0], *[[int(x) for x in rng.choice([0, 0, 1, 7], n)] for n in (1, 2, 3, 9)]]
    expected = []
    for c in contexts:
        kept = [x for x in c or [] if x != 0]
        expected.append(kept[-1] if kept and kept[-1] is not None else -1)
    for part in (slice(None), slice(3, 7), slice(0, 0)):
        assert last_known(pa.array(contexts[part], pa.list_(pa.int32())), 0).tolist() == expected[part]


@pytest.mark.parametrize("max_bytes", [1 << 20, 1])
def test_blocks_are_compared_without_copies_for_every_pair(spark, max_bytes):
    """Scattered and equal directions, a vector of zeros and IDs that come twice; all at once, or a block at a time."""
    rng = np.random.RandomState(6)
    m = rng.randn(60, 6).astype(np.float32)
    m[7], m[11], m[12], m[13] = 0, m[10], 2 * m[10], m[10]
    ids = [*range(58), 3, 4]
    table = _table(spark, ids, m)
    found, _, pairs = emb.pruned_similarities(table, 5, 8, max_bytes=max_bytes)
    assert pairs > 20 and "CoGroup" not in _plan(found)
    unit = m.astype(float) / np.maximum(np.linalg.norm(m.astype(float), axis=1, keepdims=True), 1e-300)
    cos = unit @ unit.T
    cos[np.array(ids)[:, None] == np.array(ids)[None, :]] = -np.inf
    for r in found.collect():
        # All rows of an ID together.
        expected = np.sort(np.concatenate([np.sort(cos[i])[::-1][:5] for i in range(60) if ids[i] == r.id]))[::-1][:5]
        np.testing.assert_allclose(r.sims, expected, atol=1e-9)
    assert sorted(r.id for r in found.collect()) == list(range(58))


def test_tasks_look_up_what_a_join_finds(spark):
    table = _table(spark, [1, 2, 5, 9, 30], np.random.RandomState(1).randn(5, 3))
    contexts = [[0, 0, 5], [9, 0, 0], [0, 0, 0], [], None, [2, 77], [30, 1], [2, 30]]
    rows = spark.createDataFrame([(i, 1, c) for i, c in enumerate(contexts)], "doc_id long, pos int, ctx array<int>")
    one = emb.last_token_similarity(rows, table, 2)
    two = emb.last_token_similarity(rows, table, 2, max_bytes=0)
    assert "Join" not in _plan(one) and "Join" in _plan(two)
    assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
