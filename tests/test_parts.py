import itertools
import random

from fabula.operators import models, story


def test_a_network_is_dealt_into_more_parts_as_it_grows(spark, monkeypatch):
    draw = random.Random(5)
    rows = {(a, b): draw.randrange(1, 4) for a, b in (sorted(draw.sample(range(30), 2)) for _ in range(120))}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in rows.items()], "a long, b long, weight long")
    monkeypatch.setattr(models, "ARCS", 10)
    found = models.communities(edges)
    assert found.inputFiles() and len(found.inputFiles()) > 4  # more parts than the four that the session has for shuffles
    around = {}
    for (a, b), w in rows.items():
        around.setdefault(a, {})[b] = around.setdefault(b, {})[a] = w
    label = {n: n for n in around}
    for _ in range(3):
        sums = {n: {x: sum(w for m, w in near.items() if label[m] == x) for x in {label[m] for m in near}} for n, near in around.items()}
        label = {n: max(s, key=lambda x: (s[x], -x)) for n, s in sums.items()}
    assert {r.node: r.label for r in found.collect()} == label


def test_triangles_meet_lists_not_pairs_of_edges(spark):
    draw = random.Random(6)
    pairs = {tuple(sorted(draw.sample(range(25), 2))) for _ in range(110)}
    found = story.clustering_coefficients(spark.createDataFrame([*pairs, *list(pairs)[:9]], "a long, b long"))
    assert "array_intersect" in found._jdf.queryExecution().optimizedPlan().toString()
    near = {n: {b if a == n else a for a, b in pairs if n in (a, b)} for n in {x for p in pairs for x in p}}
    want = {n: (len(o), sum(tuple(sorted(p)) in pairs for p in itertools.combinations(o, 2))) for n, o in near.items()}
    assert {r.node: (r.degree, r.triangles) for r in found.collect()} == want


def test_each_pair_of_mentions_meets_once(spark):
    draw = random.Random(7)
    rows = [(draw.randrange(6), draw.randrange(2), 1, draw.choice((0, 5, 500, 501, 1000, 1002, draw.randrange(1600)))) for _ in range(60)]
    found = story.cooccurrences(spark.createDataFrame(rows, "entity_id long, doc_id long, chapter long, start_char long"))
    want = [(x[1], 1, *sorted((x[0], y[0])), abs(x[3] - y[3])) for x, y in itertools.combinations(rows, 2) if x[1] == y[1] and x[0] != y[0] and abs(x[3] - y[3]) <= 500]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "array(-1" not in found._jdf.queryExecution().optimizedPlan().toString() and "[-1,0,1]" not in found._jdf.queryExecution().optimizedPlan().toString()
