import datetime as dt
import random

from fabula.functions import lexicons as L
from fabula.operators import alerts, corrections, joins, story, style, texts, voice

DOCS = "doc_id long, text string"


def docs(spark, *texts_):
    return spark.createDataFrame(list(enumerate(texts_)), DOCS)


def test_repetition_severity_by_distance(spark):
    filler = lambda n: " ".join("xy" for _ in range(n))  # noqa: E731  two letters, never reported
    text = lambda d: f"palabra {filler(d - 1)} palabra"
    got = {r.doc_id: (r.severity, r.min_gap, r.confidence) for r in style.lexical_repetition(docs(spark, *[text(d) for d in (9, 10, 29, 30, 50, 51)])).collect()}
    assert got == {0: ("high", 9, 0.9), 1: ("medium", 10, 0.9), 2: ("medium", 29, 0.7), 3: ("low", 30, 0.7), 4: ("low", 50, 0.7)}


def test_repetition_ignores_speech_stop_words_and_nulls(spark):
    got = style.lexical_repetition(docs(spark, "casa «casa casa» fin", "para para para", None, "", "sol sol")).collect()
    assert [(r.doc_id, r.word) for r in got] == [(4, "sol")]


def test_tension_of_equal_and_few_chapters(spark):
    one = style.tension_curve(docs(spark, "Uno dos tres.\n" * 3))
    assert [r.tension for r in one.collect()] == [0.5]
    zigzag = spark.createDataFrame([(1, i, float(i % 2)) for i in range(8)] + [(2, i, t) for i, t in enumerate([0.1, 0.2, 0.9, 0.8, 0.2, 0.1])] + [(3, 0, 0.5), (3, 1, 0.9)], "doc_id long, chapter long, tension double")
    assert {r.doc_id: r.arc for r in style.tension_arc(zigzag).collect()} == {1: "wave", 2: "mountain", 3: "flat"}


def test_voice_of_one_line_and_empty(spark):
    lines = spark.createDataFrame([(1, 0, "a", "hola tú"), (1, 1, "b", None)], "conv_id long, turn long, role string, text string")
    got = {r.role: r for r in voice.profiles(lines).collect()}
    assert got["a"].std_words == 0 and got["a"].n_once == 2 and got["b"].n_words == 0
    assert voice.profiles(lines.limit(0)).count() == 0


def test_band_join_edges_and_nearest(spark):
    a = spark.createDataFrame([(1, i, p) for i, p in enumerate((0, 100, 205, 1000))], "k long, a long, at long")
    b = spark.createDataFrame([(1, i, p) for i, p in enumerate((100, 200, 300, 301, -100))], "k long, b long, other long")
    got = {(r.a, r.b) for r in joins.band_join(a, b, ["k"], "at", "other", 100).collect()}
    want = {(i, j) for i, p in enumerate((0, 100, 205, 1000)) for j, q in enumerate((100, 200, 300, 301, -100)) if abs(p - q) <= 100}
    assert got == want
    near = {r.a: (r.b, r.distance) for r in joins.nearest(a, b, ["k"], ["k", "a"], "at", "other", 100, "b").collect()}
    assert near == {0: (0, 100), 1: (0, 0), 2: (1, 5)}


def test_as_of(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (2, 1), (1, 1)], "k long, t long")
    right = spark.createDataFrame([(1, 5, "x"), (1, 7, "y")], "k long, t long, v string")
    assert {(r.k, r.t): r.v for r in joins.as_of(left, right, ["k"], ["t"], "v").collect()} == {(1, 5): "x", (1, 10): "y", (2, 1): None, (1, 1): None}


def test_adaptive_fold_matches_a_loop(spark):
    g = random.Random(1)
    rows = [(i % 3, "t", i, i, g.random() < 0.7) for i in range(120)]
    df = spark.createDataFrame(rows, "project_id long, alert_type string, ts long, alert_id long, dismissed boolean")
    got = {r.project_id: r.weight for r in alerts.adaptive_weights(df.repartition(5)).collect()}
    for p in range(3):
        w = 1.0
        for r in rows:
            if r[0] == p:
                w = round(max(0.1, min(1.0, w + (-0.05 if r[4] else 0.025))), 4)
        assert abs(got[p] - w) < 1e-9
    many = spark.createDataFrame([(9, "t", i, i, True) for i in range(40)], df.schema)
    assert alerts.adaptive_weights(many).first().weight == 0.1


def test_decay_floor_and_types(spark):
    a = spark.createDataFrame([(1, "x", "m", 10, 0.8), (2, "x", "m", 110, 0.8), (3, "y", "m", 110, 0.8), (4, "x", "m", None, 0.8)], "alert_id long, alert_type string, source_module string, chapter long, confidence double")
    f = spark.createDataFrame([("x", "m", 1.0)], "alert_type string, source_module string, factor double")
    got = {r.alert_id: round(r.effective, 4) for r in alerts.effective_confidence(a, f, 10, ("x",)).collect()}
    assert got == {1: 0.8, 2: 0.15, 3: 0.8, 4: 0.8}


def test_suppression_globs(spark):
    a = spark.createDataFrame([(1, "spelling_typo", "nlp.spell"), (2, "grammar", "nlp"), (3, "a.b", "x")], "alert_id long, alert_type string, source_module string")
    rules = spark.createDataFrame([("spelling_*", None), ("a?b", "x")], "type_glob string, module_glob string")
    assert [r.alert_id for r in alerts.suppressed(a, rules).collect()] == [2]


EVENTS = "doc_id long, event_id long, chapter long, start_char long, story_date date, is_dated boolean, number long"


def test_timeline_rules(spark):
    d = lambda y: dt.date(y, 1, 1)
    e = spark.createDataFrame([(1, 1, 1, 0, d(2000), True, 4), (1, 2, 1, 50, d(1990), True, 3), (1, 3, 2, 0, None, False, 2), (1, 4, 2, 10, None, False, 5), (2, 5, 1, 0, None, False, 1)], EVENTS)
    assert [(r.event_id, r.kind) for r in story.narrative_order(e).collect()] == [(2, "analepsis")]
    assert {r.event_id: r.anchor for r in story.nearest_anchor(e).collect()} == {3: "1990-01-01", 4: "1990-01-01"}
    assert [r.event_id for r in story.suspicious_jumps(e).collect()] == [2]
    assert {r.doc_id: (r.opened, r.unmatched, r.left_open) for r in story.continuity(e).collect()} == {1: (2, 0, 0), 2: (0, 1, 0)}


def test_graph_and_search(spark):
    x = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (4, 5)], "a long, b long")
    assert {r.node: r.coefficient for r in story.clustering_coefficients(x).collect()} == {1: 1.0, 2: 1.0, 3: 0.333333, 4: 0.0, 5: 0.0}
    assert {r.node: r.depth for r in story.bounded_search(x, 1).collect()} == {1: 0, 2: 1, 3: 1, 4: 2}


def test_dates_and_years(spark):
    rows = spark.createDataFrame([(1, "El 3 de marzo de 1999 y el 31 de febrero de 2001."), (2, None)], "row_id long, text string")
    assert [(r.row_id, str(r.date)) for r in texts.absolute_dates(rows).collect()] == [(1, "1999-03-03")]
    assert [(r.n, r.epoch) for r in texts.years(docs(spark, "En 1850 y 1860.", "9999 123")).collect()] == [(2, "siglo xix")]


def test_near_sentences_equals_brute_force(spark):
    g = random.Random(4)
    sents = []
    for _ in range(30):
        base = [f"w{g.choice('abcdefgh')}{g.choice('abcdefgh')}" for _ in range(12)]
        sents += [base, base[:-1] + ["zz"]] if g.random() < 0.5 else [base]
    df = docs(spark, " ".join(" ".join(s) + "." for s in sents))
    got = {(r.a, r.b) for r in texts.near_sentences(df, 0.8).collect()}
    want = {(i, j) for i in range(len(sents)) for j in range(i + 1, len(sents)) if len(set(sents[i]) & set(sents[j])) / len(set(sents[i]) | set(sents[j])) >= 0.8}
    assert got == want


def test_operators_on_empty_and_null_texts(spark):
    odd, none = docs(spark, None, "", " ", "."), docs(spark, "x").limit(0)
    for f in (style.readability, style.sentence_length_buckets, style.sticky_sentences, style.filler_words, style.dialogue_density, style.sensory_report, style.point_of_view, style.chapter_metrics, style.tension_curve,
              style.chapter_balance, style.dense_blocks, style.crutch_words, style.typography, style.clarity, style.acronyms, style.regional_terms, style.neighbour_paragraph_overlap, style.glossary_candidates,
              style.register_changes, style.quote_style, texts.sentence_duplicates, texts.fingerprints, texts.fingerprint_matches, texts.page_and_line, texts.offsets_to_paragraphs, texts.headings, texts.years):
        f(odd).collect()
        assert f(none).count() == 0, f.__name__
    assert len(style.classify_documents(odd, {"a": L.FIRST_PERSON}).collect()) == 4


def test_overlapping_spans_keep_the_longer(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 3, 12), (1, 11, 13), (1, 13, 14), (2, 0, 1), (2, None, 3)], "doc_id long, start long, stop long")
    assert sorted(tuple(r) for r in corrections.without_overlaps(rows).collect()) == [(1, 3, 12), (1, 13, 14), (2, 0, 1)]


def test_folds_of_one_hot_key_are_spread(spark):
    g = random.Random(2)
    rows = [(1, "t", i, i, g.random() < 0.4) for i in range(4000)]
    df = spark.createDataFrame(rows, "project_id long, alert_type string, ts long, alert_id long, dismissed boolean").repartition(4)
    w = 1.0
    for r in rows:
        w = round(max(0.1, min(1.0, w + (-0.05 if r[4] else 0.025))), 4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = alerts.adaptive_weights(df)
        assert tuple(got.first()) == (1, "t", w, 4000, sum(r[4] for r in rows))
        parts = df.select("project_id", "alert_type", "ts", "alert_id", "dismissed").repartitionByRange("project_id", "alert_type", "ts").sortWithinPartitions("ts").mapInArrow(alerts._clamped_sums(0.05), "project_id long, alert_type string, part long, shift long, low long, high long, n long, gone long").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(parts) > 1 and sum(p.n for p in parts) == 4000 and max(p.n for p in parts) < 3000


def test_span_folds_hold_one_island(spark):
    g = random.Random(3)
    rows = [(1, a, a + g.randrange(1, 9)) for a in (g.randrange(3000) for _ in range(600))]
    kept = []
    for start, stop in sorted(r[1:] for r in rows):
        if not kept or start >= kept[-1][1]:
            kept.append((start, stop))
        elif stop - start > kept[-1][1] - kept[-1][0]:
            kept[-1] = (start, stop)
    out = corrections.without_overlaps(spark.createDataFrame(rows, "doc_id long, start long, stop long"))
    assert sorted((r.start, r.stop) for r in out.collect()) == kept
    assert "island" in out._jdf.queryExecution().optimizedPlan().toString()


def test_confused_words_reads_texts_once_whatever_the_pairs(spark, tmp_path):
    from fabula.operators import style

    spark.createDataFrame([(1, "Haya o halla, ver y haber; " + "nada " * 20 + "haya"), (2, "halla"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    pairs = (("halla", "haya"), ("haber", "ver"), ("haya", "ver"))
    found = style.confused_words(spark.read.parquet(f"{tmp_path}/d"), pairs)
    assert "token_lc" not in str(found.columns) and f"{tmp_path}/d" not in found._jdf.queryExecution().executedPlan().toString().replace("\n", "")
    assert sorted(tuple(r) for r in found.collect()) == [(1, 0, 1, "haya", "ver"), (1, 2, 1, "halla", "haya"), (1, 5, 1, "haber", "ver")]


def test_words_of_a_lexicon_are_counted_without_an_array_of_all_words(spark):
    from fabula.operators import style

    docs = spark.createDataFrame([(1, "Él me vio; ME, me... mesa yo"), (2, None), (3, "nada")], "doc_id long, text string")
    df = style.classify_documents(docs, {"a": ("me", "yo", "mesas"), "b": ("él",)})
    assert {r.doc_id: (r.type, r.confidence) for r in df.collect()} == {1: ("a", 0.8), 2: ("unknown", 0.0), 3: ("unknown", 0.0)}
    assert "split" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_sensory_words_are_counted_without_an_array_of_all_words(spark):
    from fabula.operators import style

    df = style.sensory_report(spark.createDataFrame([(1, "Luz, luces; xluz luzabcd"), (2, None), (3, "nada")], "doc_id long, text string"), {"sight": ("luz", "luc"), "touch": ("piel",)})
    assert {r.doc_id: (r.sight, r.touch, r.per_1000) for r in df.collect()} == {1: (2, 0, 500.0), 3: (0, 0, 0.0)}
    assert "split" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_alert_diff_meets_alerts_by_entity_not_in_pairs(spark):
    """Many alerts of one type and chapter: the results of comparing all pairs, but no join tests pairs for a shared entity."""
    g = random.Random(4)
    rows = [(i, 1, "t", g.choice([3, 3, 3, None]), [g.choice([g.randrange(60), None]), g.randrange(60)] if i % 9 else None, f"title {i}") for i in range(240)]
    df = spark.createDataFrame(rows, "alert_id long, project_id long, alert_type string, chapter long, entity_ids array<long>, title string")
    found = alerts.diff(df.filter("alert_id % 2 = 0"), df.filter("alert_id % 3 = 0"))
    want = {}
    new = [r for r in rows if r[0] % 3 == 0]
    same = {r[0]: r[0] for r in new if r[0] % 2 == 0}
    for old in (r for r in rows if r[0] % 2 == 0):
        shared = [r[0] for r in new if r[0] not in same.values() and old[3] == r[3] == 3 and (set(old[4] or []) & set(r[4] or [])) - {None}]
        want[old[0]] = (same[old[0]], "hash", 1.0) if old[0] in same else (min(shared), "entity", 0.8) if shared else (-1, "removed", 0.5)
    assert {r.old_id: (r.new_id, r.how, r.score) for r in found.collect()} == want
    assert {h for _, h, _ in want.values()} == {"hash", "entity", "removed"}
    kept = []
    overlap, alerts.F.arrays_overlap = alerts.F.arrays_overlap, lambda *a: kept.append(a)
    expr, alerts.F.expr = alerts.F.expr, lambda e: kept.append(e) if "arrays_overlap" in e else expr(e)
    try:
        alerts.diff(df, df)
    finally:
        alerts.F.arrays_overlap, alerts.F.expr = overlap, expr
    assert not kept
