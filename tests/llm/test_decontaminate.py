import re

from fabula.llm import decontaminate

DOCS = "doc_id long, text string, extra int, pos int"
ITEMS = "item_id long, text string"


def brute(docs, items):
    ws = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for doc_id, text, *_ in docs:
        d, hit, ids = ws(text), set(), set()
        for item_id, item in items:
            i = ws(item)
            n = min(13, len(i))
            grams = {tuple(i[k : k + n]) for k in range(len(i) - n + 1)} if n else set()
            for k in range(len(d) - n + 1 if n else 0):
                if tuple(d[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    ids |= {str(item_id)} if item_id is not None else set()
        out.append((doc_id, len(d), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(d)))
    return sorted(out, key=str)


def check(spark, docs, items):
    got = decontaminate.report(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, items)


def words(a, b):
    return " ".join(f"w{i}" for i in range(a, b))


def test_spans_edges_and_short_items(spark):
    items = [(1, words(0, 30)), (2, "Alpha, beta"), (3, words(100, 113)), (4, None), (5, "!!!"), (1, words(0, 30)), (None, "lonely item text")]
    docs = [
        (1, f"x {words(3, 16)} y", 0, 0), (2, f"x {words(3, 15)} y", 0, 0), (3, words(100, 113).upper(), 0, 0), (4, None, 0, 0), (5, "", None, None),
        (6, "alpha BETA gamma alpha-beta", 0, 0), (7, f"{words(0, 20)} gap {words(10, 30)}", 0, 0), (None, words(0, 13), 0, 0), (8, "a lonely item text", 0, 0),
        (8, "a lonely item text", 0, 0), (9, " ".join(["w1"] * 500), 0, 0), (10, words(1000, 6000) + " " + words(0, 13), 0, 0),
    ]
    check(spark, docs, items)


def test_repetitive_items_and_empty_tables(spark):
    check(spark, [(1, "a b " * 40, 0, 0), (2, "b a " * 7, 0, 0)], [(1, "a b " * 10)])
    check(spark, [(1, "a b c", 0, 0)], [])
    check(spark, [], [(1, "a b")])


def test_clean_keeps_other_columns(spark):
    docs = spark.createDataFrame([(1, words(0, 13), 7, 8), (2, "fine", 9, 10), (None, None, None, None)], DOCS)
    left = decontaminate.clean(docs, spark.createDataFrame([(1, words(0, 20))], ITEMS))
    assert left.columns == docs.columns
    assert sorted((tuple(r) for r in left.collect()), key=str) == [(2, "fine", 9, 10), (None, None, None, None)]
