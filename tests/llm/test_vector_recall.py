"""Every link of a visit is found: islands that no graph search reaches, between two shards."""

import numpy as np

from gleaner.llm import embeddings


def test_planted_groups_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "SHARD", 300)
    rng = np.random.default_rng(11)
    base = rng.standard_normal((1500, 24))
    groups = [base[k] + rng.standard_normal((60, 24)) * 0.07 for k in (3, 500, 900)]
    pairs = base[::10] + rng.standard_normal((150, 24)) * 0.03
    v = np.concatenate([base, *groups, pairs])
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, [float(x) for x in w], 1) for i, w in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicate_vectors(df).collect()}
    assert near.sum() > 1_000
    assert [got[i] for i in range(len(v))] == near.sum(1).tolist()
