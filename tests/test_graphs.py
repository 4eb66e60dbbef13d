"""Components, leaders, chains and clusters against loops over single rows."""

import random
from collections import defaultdict

import numpy as np

from fabula.operators import chains as H
from fabula.operators import clusters as G
from fabula.operators import graphs


def union(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


def test_components_are_those_of_union_find(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(300)] + [(9, 9), (5000, 5000)]
    rows = [*pairs, *pairs[:20], (None, 3), (4, None)]
    got = {r.node: r.component for r in graphs.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == union(pairs)
    words = graphs.components(spark.createDataFrame([("b", "a"), ("c", "b"), ("y", "x")], "a string, b string")).collect()
    assert {(r.node, r.component) for r in words} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_leaders_are_those_of_one_pass(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(150)] + [(i, i + 1) for i in range(200, 212)]
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for x in sorted(near):
        if x not in want:
            want[x] = x
            for y in near[x]:
                if y > x:
                    want.setdefault(y, x)
    got = {r.node: r.leader for r in graphs.leaders(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want
    assert graphs.leaders(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chains_elect_a_proper_noun(spark):
    rng, pairs, proper = random.Random(5), [], []
    for doc in range(12):
        pairs += [(doc, rng.randrange(40) * 7, rng.randrange(40) * 7, rng.choice([0.5, 0.75, 1.0])) for _ in range(18)]
        proper += [(doc, p * 7) for p in range(40) if rng.random() < 0.2]
    got = H.build_chains(spark.createDataFrame(pairs, "doc_id long, anaphor long, antecedent long, score double"), spark.createDataFrame(proper, "doc_id long, place long")).collect()
    for doc in range(12):
        mine = [p for p in pairs if p[0] == doc]
        roots = union([p[1:3] for p in mine])
        members = defaultdict(list)
        for x, r in roots.items():
            members[r].append(x)
        rows = {r.place: r for r in got if r.doc_id == doc}
        assert set(rows) == set(roots)
        for xs in members.values():
            named = [x for x in xs if (doc, x) in proper]
            scores = [p[3] for p in mine if p[1] in xs]
            for x in xs:
                assert (rows[x].root, rows[x].n) == (min(named or xs), len(xs)) and abs(rows[x].confidence - sum(scores) / len(scores)) < 1e-9
                assert rows[x].chain == rows[xs[0]].chain


def test_pronouns_and_aliases(spark):
    text = "Ana Ruiz llegó. Ella miró. Pedro Gil, el Capitán, calló; él esperaba." + " x" * 200 + " Ella. Y la Reina."
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    entities = spark.createDataFrame([(1, "Ana Ruiz", ["Ana"]), (2, "Pedro Gil", None)], "entity_id long, name string, aliases array<string>")
    mentions = spark.createDataFrame([(1, 1, 0, 8), (1, 2, 27, 36)], "doc_id long, entity_id long, start long, stop long")
    rows = {r.place: r for r in H.chains(docs, mentions).collect()}
    assert rows[0].n == 2 and rows[text.index("Ella")].root == 0 and rows[text.index("él")].root == 27
    assert text.rindex("Ella") not in rows
    found = H.found_aliases(docs, entities)
    assert {(r.alias, r.anchor, text[r.start : r.stop]) for r in found.collect()} == {("el Capitán", "Pedro Gil", "el Capitán"), ("la Reina", None, "la Reina")}
    resolved = {r.alias: (r.entity_id, r.source) for r in H.resolve_aliases(found, entities, mentions, H.chains(docs, mentions)).collect()}
    assert resolved["el Capitán"] == (2, "pattern") and resolved["la Reina"] == (2, "coreference")
    near = H.resolve_aliases(found.drop("anchor").withColumn("anchor", found["alias"]), entities, mentions, H.chains(docs, mentions))
    assert {r.alias: r.source for r in near.collect()}["el Capitán"] == "context"
    assert {(r.alias, r.n, r.source) for r in H.alias_clusters(near).collect()} == {("el Capitán", 1, "context"), ("la Reina", 1, "coreference")}


def test_name_clusters_equal_the_greedy_pass(spark):
    names = ["María Sánchez", "Sanchez Maria", "Mari Sanches", "Don Pedro Gil", "Pedro Gill", "Pedro", "Ana", "Ana María", "Luis", "Luisa", "X", "", "Maria Sanchis", "Gil"]
    rows = [(s, s * 100 + i, n) for s in (1, 2) for i, n in enumerate(names) if (s + i) % 5 or s == 1] + [(3, 300, "Ana"), (3, 301, None)]
    df = spark.createDataFrame(rows, "scope long, id long, name string")
    scores = {(r.a, r.b): r.score for r in G.like_names(df).collect()}
    got = {r.id: r.cluster for r in G.name_clusters(df).collect()}
    for scope in (1, 2):
        mine = [(i, n) for s, i, n in rows if s == scope and n]
        prints = defaultdict(list)
        for i, n in mine:
            form = " ".join(sorted(w for w in n.lower().replace("á", "a").replace("í", "i").split() if w != "don"))
            prints[form].append(i)
        want = {i: ids[0] for ids in prints.values() if len(ids) > 1 for i in ids}
        free = [i for ids in prints.values() if len(ids) == 1 for i in ids]
        taken = set()
        for i in sorted(free):
            if i not in taken:
                mates = [j for j in sorted(free) if j > i and j not in taken and scores.get((i, j), 0) >= G.LIKE]
                taken |= {i, *mates}
                want |= {j: i for j in [i, *mates] if mates}
        assert {i: c for i, c in got.items() if i // 100 == scope} == want and len(want) >= 6
    assert abs(scores[103, 104] - (0.6 * G.blocks_ratio("pedro gil", "pedro gill") + 0.4 * 7 / 12)) < 1e-9
    pairs = {(r.a, r.b) for r in G.pairs_within(G.name_clusters(df)).collect()}
    assert pairs == {(a, b) for a in got for b in got if a < b and got[a] == got[b]}


def naive_ward(d):
    clusters = {i: [i] for i in range(len(d))}
    d2 = {(i, j): d[i, j] ** 2 for i in range(len(d)) for j in range(len(d)) if i < j}
    heights = []
    while len(clusters) > 1:
        (a, b), v = min(d2.items(), key=lambda x: (x[1], x[0]))
        heights.append(v**0.5)
        na, nb = len(clusters[a]), len(clusters[b])
        for k in clusters:
            if k not in (a, b):
                nk = len(clusters[k])
                x, y = tuple(sorted((a, k))), tuple(sorted((b, k)))
                d2[x] = ((na + nk) * d2[x] + (nb + nk) * d2.pop(y) - nk * v) / (na + nb + nk)
        del d2[a, b]
        clusters[a] += clusters.pop(b)
    return heights


def test_ward_equals_the_naive_tree(spark):
    rng = np.random.default_rng(1)
    for n in (2, 3, 8, 25):
        m = rng.random((n, n))
        d = 1 - (m + m.T) / 2
        np.fill_diagonal(d, 0)
        assert np.allclose([h for *_, h in G.ward(d)], naive_ward(d))
    rows = [(7, a, b, 9) for a in (1, 2, 3) for b in (1, 2, 3) if a < b] + [(7, 5, 4, 9), (7, 1, 4, 1), (8, 1, 2, 3), (None, 1, 2, 1), (9, 1, 1, 5)]
    got = {(r.story, r.entity_id): r.cluster for r in G.relationship_clusters(spark.createDataFrame(rows, "story long, a long, b long, strength long")).collect()}
    assert [got[7, i] for i in range(1, 6)] == [1, 1, 1, 4, 4] and got[8, 2] == 1 and (None, 1) in got and (9, 1) not in got
