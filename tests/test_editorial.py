import random

from fabula.operators import alerts, editorial, models, story, texts

SCHEMA = "doc_id long, text string"


def docs(spark, *ts):
    return spark.createDataFrame(list(enumerate(ts)), SCHEMA)


def test_found_mentions(spark):
    t = "Ana López vio a Ana López. Luego Ana López Ana López y Marta. Marta, Marta"
    got = sorted((r.word_idx, r.name) for r in editorial.found_mentions(docs(spark, t, None, "")).collect())
    assert got == [(0, "Ana López"), (4, "Ana López"), (7, "Ana López"), (9, "Ana López"), (12, "Marta"), (13, "Marta"), (14, "Marta")]


def test_paragraph_diffs_are_bags(spark):
    r = editorial.paragraph_diffs(docs(spark, "a\nb\nb\nc"), docs(spark, "b\na\nd")).first()
    assert (r.kept, r.removed, r.added, r.ratio) == (2, 2, 1, round(4 / 7, 6))


def test_imports_and_votes(spark):
    l = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("c", 1, None), ("d", 1, 1), ("e", 1, 1)], "key string, value int, at int")
    i = spark.createDataFrame([("a", 2, 5), ("b", 2, None), ("c", 2, 1), ("d", 1, 9), ("n", 3, 1)], "key string, value int, at int")
    assert {r.key: (r.status, r.value) for r in editorial.imported_decisions(l, i).collect()} == {"a": ("taken_over", 2), "b": ("kept", 1), "c": ("taken_over", 2), "d": ("same", 1), "e": ("only_local", 1), "n": ("new", 3)}
    v = spark.createDataFrame([(1, 2, "k", "x", 0.9, 1.0), (1, 2, "k", "y", 0.7, 1.0), (1, 3, "k", "x", 0.2, 1.0)], "a long, b long, kind string, method string, score double, weight double")
    assert [(r.b, r.confidence, r.best) for r in editorial.relationship_vote(v).collect()] == [(2, 0.92, "x")]


def test_modified_areas_equal_brute_force(spark):
    g = random.Random(1)
    p = [(1, 1, i, s, s + g.randrange(1, 50)) for i, s in enumerate(g.randrange(5000) for _ in range(80))]
    c = [(1, 1, g.randrange(5000)) for _ in range(15)]
    got = {r.entity_id: r.n_changes for r in editorial.in_modified_area(spark.createDataFrame(p, "doc_id long, chapter long, entity_id long, start_char long, end_char long"), spark.createDataFrame(c, "doc_id long, chapter long, at long")).collect()}
    want = {i: sum(a - 200 < e and a + 250 > s for _, _, a in c) for _, _, i, s, e in p}
    assert got == {i: n for i, n in want.items() if n}


def test_places_are_shuffled_once_to_changes_and_counted_there(spark):
    p = spark.createDataFrame([(1, 1, 7, 400, 420), (1, 1, 7, 400, 420), (1, 2, 7, 400, 420)], "doc_id long, chapter long, entity_id long, start_char long, end_char long")
    c = spark.createDataFrame([(1, 1, 610), (1, 1, 150), (1, 1, 151), (1, 1, 620)], "doc_id long, chapter long, at long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = editorial.in_modified_area(p, c)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r) for r in found.collect()] == [(1, 1, 7, 400, 420, 4)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 2


def test_names_alike_equal_brute_force(spark):
    g = random.Random(2)
    names = ["".join(g.choice("abc") for _ in range(g.randrange(1, 9))) for _ in range(120)]
    e = [(i, n, g.choice("xy")) for i, n in enumerate(names)]
    grams = lambda n: {n[i : i + 3] for i in range(len(n) - 2)}
    classes = {}
    for i, n, t in e:
        classes.setdefault((t, n), []).append(i)
    want = {(v[0], v[-1], 1.0, len(v)) for v in classes.values() if len(v) > 1}
    for (t, x), a in classes.items():
        for (u, y), b in classes.items():
            both = len(grams(x) & grams(y))
            if t == u and a[0] < b[0] and both and both / len(grams(x) | grams(y)) >= 0.5:
                want.add((a[0], b[0], round(both / len(grams(x) | grams(y)), 6), len(a) + len(b)))
    got = story.merge_suggestions(spark.createDataFrame(e, "entity_id long, name string, entity_type string"), top=10_000).collect()
    assert {tuple(r) for r in got} == want
    books = [(i % 2, i, n, t) for i, n, t in e]
    links = models.link_suggestions(spark.createDataFrame(books, "book long, entity_id long, name string, entity_type string"), spark.createDataFrame([], "a long, b long")).collect()
    of = {(k % 2, names[k], e[k][2]): k for k in reversed(range(len(e)))}
    pairs = {(a, b) for (p, x, t), a in of.items() for (q, y, u), b in of.items() if p < q and t == u and (x == y or grams(x) and len(grams(x) & grams(y)) / len(grams(x) | grams(y)) >= 0.5)}
    assert {(r.a, r.b) for r in links} == pairs


def test_identity_of_long_texts_and_whole_cleanup(spark):
    long = " ".join(f"palabra{i % 700}" for i in range(5000)).translate(str.maketrans("0123456789", "abcdefghij"))
    got = {r.pair: r.kind for r in texts.identity(spark.createDataFrame([(0, long), (1, long + " fin"), (2, long), (3, "x")], SCHEMA)).collect()}
    assert got == {0: "same", 1: "different"}
    a = spark.createDataFrame([(1, i, i) for i in range(7)], "project_id long, alert_id long, created_at long")
    assert {r.alert_id: r.removed for r in alerts.latest_versions(a, 2).collect()} == {i: i < 5 for i in range(7)}


def test_empty_and_null_texts(spark):
    odd, none = docs(spark, None, "", " ", "."), docs(spark, "x").limit(0)
    for f in (editorial.paragraph_duplicates, editorial.scene_stats, editorial.attributions, editorial.prefix_search, editorial.found_mentions, lambda d: editorial.register_scores(d, {"a": ("x",), "b": ("y",)}), lambda d: editorial.paragraph_diffs(d, d), lambda d: editorial.speech_kinds(d, "dash")):
        f(odd).collect()
        assert f(none).count() == 0


def test_undo_difficulty_and_spellings(spark):
    rng, rows, want = random.Random(1), [], {}
    for user in range(30):
        stack = []
        for i in range(rng.randrange(25)):
            kind = rng.choice(["a", "b", "undo", "undo"])
            rows.append((user, 100 * user + i, kind, float(i), i // 2))
            if kind != "undo":
                stack.append(rows[-1])
            elif stack:
                stack.pop()
        if stack:
            want[user] = (len(stack), *stack[-1][1:4])
    log = spark.createDataFrame(rows, "user_id long, event_id long, event_type string, value double, ts long")
    assert {r[0]: tuple(r)[1:] for r in editorial.after_undo(log, "undo").collect()} == want and len(want) > 10
    r = editorial.word_difficulty(docs(spark, "sol sol mariposa", None)).first()
    assert (r.n_words, r.simple, r.complex, r.diversity) == (3, round(2 / 3, 6), round(1 / 3, 6), round(2 / 3, 6))
    assert [(r.norm, r.forms, r.canonical) for r in editorial.equal_spellings(docs(spark, "Ávila Avila Ávila Toledo", "")).collect()] == [("avila", 2, "Ávila")]
