import numpy as np

from fabula.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(data, k):
    ok = {}
    for i, v in ((i, v) for i, v, *_ in data):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = min(ok.get(i, v), v)
    out = {}
    for q, v in ok.items():
        if q % 20 == 0:
            found = [(-float(np.dot(np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float))), i) for i, w in ok.items() if i != q and len(w) == len(v)]
            out[q] = sorted(found)[:k]
    return out


def test_small_table_is_complete(spark):
    g = np.random.default_rng(0)
    data = [(i, [float(np.float32(x)) for x in g.standard_normal(8)], 1) for i in range(15)] + [(20, [1.0] * 8, 1), (40, None, 0), (60, [0.0] * 8, 0), (80, [float("nan")] * 8, 0), (100, [1.0, None], 0), (None, [1.0] * 8, 0), (21, [1.0] * 8, 1), (22, [1.0] * 8, 1), (120, [1.0, 2.0], 1), (121, [2.0, 1.0], 1), (122, [float("inf"), 1.0], 0), (21, [1.0] * 8, 1)]
    got = {}
    for r in ann.digest(spark.createDataFrame(data, SCHEMA)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(data, 20)
    assert set(got) == set(want)
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
        assert [r[1] for r in rows] == [i for _, i in want[q]]
        assert np.allclose([r[2] for r in rows], [-s for s, _ in want[q]])


def test_recall_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "DATA_BLOCK", 700)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "90")  # blocks and batches end at different rows
    g = np.random.default_rng(1)
    data = [(i, [float(x) for x in g.standard_normal(32).astype(np.float32) * (1 + i % 3)], 0) for i in range(2000)]
    got = {}
    for r in ann.digest(spark.createDataFrame(data, SCHEMA)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {q: {i for _, i in rows} for q, rows in brute(data, 20).items()}
    assert all(len(v) == 20 for v in got.values())
    assert np.mean([len(got[q] & want[q]) / 20 for q in want]) >= 0.9


def test_empty(spark):
    assert ann.digest(spark.createDataFrame([], SCHEMA)).count() == 0
