"""The sample that the index of nearest neighbours is fitted on: bounded in bytes, of the table's most common length."""

import numpy as np

from factloom.llm import ann


def test_sample_is_bounded_by_bytes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000 + i, [1.0] * 300) for i in range(40)] + [(3000, None), (3001, []), (None, [1.0] * 24), (3002, [0.0] * 24), (3003, [float("nan")] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "SAMPLE_BYTES", 8 * 24 * 400)
    monkeypatch.setattr(ann, "LIST_SIZE", 100)
    index = ann.fit(df, 20)
    assert index.sample.shape[1] == 24 and 390 <= len(index.sample) <= 400 and len(index.sample_ids) == len(index.sample_lists) == len(index.sample)
    assert all((index.sample[i] == x[index.sample_ids[i]]).all() for i in range(0, len(index.sample), 37))
    got = ann.search(df, df.filter("vec_id % 20 = 0"), 20).collect()
    ids = range(0, 1500, 20)
    scores = x @ x.T
    want = {q: set(sorted((i for i in range(1500) if i != q), key=lambda i: (-scores[q, i], i))[:20]) for q in ids}
    assert {r["query_id"] for r in got} == set(ids)
    assert sum(r["vec_id"] in want[r["query_id"]] for r in got) >= 0.9 * 20 * len(want)


def test_no_usable_vector_gives_no_index(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.0, 0.0])], [(None, [1.0])]):
        assert ann.fit(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 3) is None
