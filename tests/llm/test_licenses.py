import re

from fabula.llm import licenses as L

DOCS = "doc_id long, text string, license string, key int"


def words(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())


def brute(docs, named):
    grams = lambda ws, n: {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}
    out = set()
    for doc_id, text, *_ in docs:
        for name, template in named.items():
            t = words(template)
            n = min(5, len(t))
            held = grams(t, n) & grams(words(text), n)
            if t and len(held) >= 0.8 * len(grams(t, n)):
                out.add((doc_id, name, len(held) / len(grams(t, n))))
    return out


def test_against_brute_force(spark):
    mit, gpl = L.TEMPLATES["mit-notice"].split(), L.TEMPLATES["gpl-notice"].split()
    docs = [(i, f"{'pad ' * i}{t}{' pad' * i}", "x", i) for i, t in enumerate(L.TEMPLATES.values())]
    docs += [(100 + k, " ".join(["lead"] * k + mit[: len(mit) - k] + ["tail"] * k), "x", 0) for k in range(0, 40, 3)]
    docs += [(200, " ".join(w if i != 20 else "edited" for i, w in enumerate(gpl)), None, None), (201, None, None, None), (202, "", "x", 0), (203, "all rights", "x", 0), (204, "word " * 5000 + "All  RIGHTS-reserved!", "x", 0), (None, "released under the MIT license", "x", 0)]
    got = {(r.doc_id, r.license, r.containment) for r in L.digest(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == brute(docs, L.TEMPLATES)


def test_empty(spark):
    assert L.digest(spark.createDataFrame([], DOCS)).count() == 0


def test_repeated_rows_scattered_shingles_and_templates_of_every_length(spark):
    ws = [f"w{i}" for i in range(60)]
    named = {f"t{n}": " ".join(ws[:n]) for n in (1, 2, 3, 4, 5, 6, 9, 11, 12, 13, 20, 60)} | {"none": "?!", "repeated": "again and " * 15}
    # the shingles of a template in reverse order, far apart: containment is of the whole text, not of one window
    scattered = " ".join(" ".join(ws[i : i + 5]) + " gap" * 50 for i in reversed(range(56)))
    docs = [(n, " ".join(["x"] * n + ws[:n]), "x", 0) for n in range(0, 61)] + [(7, " ".join(["x"] * 7 + ws[:7]), "x", 0)] * 3 + [(100, scattered, "x", 0), (101, "again and " * 3000, "x", 0)]
    got = [(r.doc_id, r.license, r.containment) for r in L.digest(spark.createDataFrame(docs, DOCS), named).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, named)
    assert L.digest(spark.createDataFrame(docs, DOCS), {"none": "?!"}).count() == 0
