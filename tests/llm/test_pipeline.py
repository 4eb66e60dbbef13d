import random

import corpus_pipeline
from fabula.llm import registry


def test_run_against_its_parts(spark, tmp_path):
    g = random.Random(5)
    word = lambda: "".join(g.choice("ba de lo mi nu ra so ti".split()) for _ in range(g.randrange(1, 4)))
    docs, labels = [], []
    for i in range(300):
        ws = [word() for _ in range(60)]
        bad = i % 10 == 0
        ws[5:5] = ["nastyword", "nastyword"] if bad else []
        docs.append((i, " ".join(ws), "en", "s", len(" ".join(ws))))
        labels.append((i, 1, int(bad)))
    bench = " ".join("bench%d" % k for k in range(30))
    docs += [(1000, docs[1][1] + " tail", "en", "s", 1), (1001, "x " + bench, "en", "s", 1), (1002, None, None, None, None), (1003, "", "en", "s", 0)]
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(1, bench)], "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i for i in range(300) if i % 10} | {1002, 1003}


def test_near_duplicates_by_five_words(spark):
    ws = ["w%d" % k for k in range(40)]
    texts = [" ".join(ws), " ".join([*ws[:20], "other", *ws[21:]]), " ".join([*ws, "tail"])]  # 1 is 0.80 like 0 by four words, 0.76 by five; 2 is near by both
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates_stage(spark, docs, "").collect()} == {0, 1}


def test_registry():
    names = registry.queries()
    assert sorted(n.split("_")[0] for n in names) == sorted(["pipeline", *(f"op{i}" for i in range(1, 14))])
    assert set(registry.oracles()) <= set(names)


def test_empty_tables_repeated_rows_and_clashing_columns(spark, tmp_path):
    text = " ".join("w%d" % k for k in range(30))
    docs = "doc_id long, text string, lang string, source string, n_chars long, toxic int, component_id long"
    other = {"labels": ([], "doc_id long, quality int, toxic int"), "benchmark": ([], "item_id long, text string")}
    for folder, rows in (("none", []), ("some", [(7, text, "en", "s", 1, 1, 2), (7, text, "en", "s", 1, 1, 2), (8, text, "en", None, 1, None, None), (None, "other words", None, "s", 1, 0, 0)])):
        for name, (r, schema) in ({"documents": (rows, docs)} | other).items():
            spark.createDataFrame(r, schema).write.parquet(f"{tmp_path}/{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    got = {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect()}
    assert 7 in got and 8 not in got
