import random

from fabula.llm import neardup, packing

SCHEMA = "doc_id long, text string, source string, bin_id int"


def test_bins_hold_no_conflict_and_everything(spark):
    g = random.Random(3)
    docs = [(i, " ".join(["w%d" % (i if i % 7 else 0)] * g.randrange(1, 90)), "s%d" % (0 if g.random() < 0.4 else g.randrange(1, 40)), 1) for i in range(800)]
    docs += [(9000 + i, "copy of one text", "c%d" % i, 1) for i in range(60)] + [(9999, None, None, None), (9998, "", None, None), (None, "odd", None, None), (7, "long " * 1000, "s1", 1)]
    got = packing.pack(spark.createDataFrame(docs, SCHEMA), capacity=100, group=300).toPandas()
    assert got.groupby("bin_id")["n_tokens"].sum().max() <= 100
    assert not got.duplicated(["bin_id", "cluster"]).any()
    for _, b in got.groupby("bin_id"):
        spans = sorted(zip(b["start"], b["start"] + b["n_tokens"]))
        assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    want = sorted((d if d is not None else -1, len((t or "").split()) + 1) for d, t, *_ in docs)
    have = got.assign(doc_id=got["doc_id"].fillna(-1)).groupby(["doc_id", "cluster"])["n_tokens"].sum().reset_index()
    assert sorted(zip(have["doc_id"].astype(int), have["n_tokens"])) == want
    cold = got[got["source"].notna() & (got["source"] != "s0")]
    counts = got["source"].value_counts(normalize=True)
    per_bin = 100 * len(got) / got["n_tokens"].sum()
    rare = cold[cold["source"].map(counts) * per_bin <= 1]
    assert not rare.duplicated(["bin_id", "source"]).any()


def test_only_sources_that_need_it_stand_twice_in_a_bin(spark):
    g = random.Random(4)
    even = [(i, " ".join(["w%d" % i] * g.randrange(5, 35)), "s%d" % (i % 20), 1) for i in range(1200)]  # 5 percent each, some 5 in a bin
    got = packing.pack(spark.createDataFrame(even, SCHEMA), capacity=100, group=300).toPandas()
    assert len(got) == 1200 and got["bin_id"].nunique() < 300
    assert not got.duplicated(["bin_id", "source"]).any()
    third = [(i, t, "big" if i % 3 == 0 else s, b) for i, t, s, b in even]
    got = packing.pack(spark.createDataFrame(third, SCHEMA), capacity=100, group=300).toPandas()
    per_bin = 100 * len(got) / got["n_tokens"].sum()
    assert got[got["source"] == "big"].groupby("bin_id").size().max() <= -(-per_bin // 3)
    assert not got[got["source"] != "big"].duplicated(["bin_id", "source"]).any()


def test_bins_are_those_of_brute_force():
    g = random.Random(6)
    n = 400
    sizes, sources, clusters = [g.randrange(1, 60) for _ in range(n)], [g.choice([None, *range(20)]) for _ in range(n)], [g.randrange(150) for _ in range(n)]
    room, held, want = [], [], [0] * n
    for i in sorted(range(n), key=lambda i: -sizes[i]):
        fits = [b for b in range(len(room)) if room[b] >= sizes[i] and clusters[i] not in held[b][1] and (sources[i] is None or sources[i] not in held[b][0])]
        if fits:
            want[i] = min(fits, key=lambda b: (room[b], b))
        else:
            want[i] = len(room)
            room.append(100)
            held.append((set(), set()))
        room[want[i]] -= sizes[i]
        held[want[i]][0].add(sources[i])
        held[want[i]][1].add(clusters[i])
    assert packing.best_fit(sizes, sources, clusters, 100)[0] == want


def test_near_copies_never_share_a_bin(spark):
    base = [f"w{i}" for i in range(40)]
    docs = [(k, " ".join([*base[:39], f"x{k}"]), f"s{k}", 1) for k in range(12)] + [(100 + k, f"other {k}", f"s{k}", 1) for k in range(12)] + [(None, " ".join(base), None, 1), (3, "again", "s", 1)]
    df = spark.createDataFrame(docs, SCHEMA)
    got = packing.pack(df, capacity=100, clusters=neardup.groups(df, size=5)).toPandas()
    assert len(got) == len(docs) and not got.duplicated(["bin_id", "cluster"]).any()
    assert got[got["doc_id"].lt(12) & got["n_tokens"].gt(30)]["cluster"].nunique() == 1


def test_successor_search():
    bins, starts = packing.best_fit([6, 5, 4, 3], [0, 1, 0, None], [0, 1, 2, 1], 10)
    assert bins == [0, 1, 1, 0] and starts == [0, 0, 5, 6]


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
