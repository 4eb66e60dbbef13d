"""Text identity, structure and vector queries over `documents`, `pages`, `embeddings` and `labels`."""

from fabula.functions import lexicons as L
from fabula.operators import texts as X
from fabula.plans.catalog import query
from fabula.plans.style_plans import PARA, SENT, TOK, WORD
from fabula.sources import tables
from fabula.sources.tables import load

PARAS = f"""{PARA}, paras AS (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY para_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char FROM para)"""


@query(f"WITH {PARAS} SELECT doc_id, para_idx, start_char, start_char + length(text) AS end_char, md5(text) AS digest FROM paras")
def paragraphs(spark, sf_dir):
    from pyspark.sql import functions as F

    return tables.paragraphs(load(spark, sf_dir, "documents")).withColumn("digest", F.md5("text")).drop("text")


@query("WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '—[^—\\n]+|«[^»\\n]+»|“[^”\\n]+”|\"[^\"\\n]+\"') AS ds FROM documents) SELECT doc_id, unnest(range(len(ds))) AS dlg_idx, unnest(ds) AS text FROM d")
def dialogue_spans(spark, sf_dir):
    return tables.dialogues(load(spark, sf_dir, "documents"))


@query(f"""WITH {SENT}, n AS (SELECT doc_id, sent_idx, lower(regexp_replace(trim(text), '\\s+', ' ', 'g')) AS norm FROM sent)
SELECT md5(norm) AS sentence, count(*) AS n, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc, arg_min(sent_idx, row(doc_id, sent_idx)) AS first_sentence FROM n WHERE length(norm) >= 30 GROUP BY norm HAVING count(*) > 1""")
def sentence_duplicates(spark, sf_dir):
    return X.sentence_duplicates(load(spark, sf_dir, "documents"))


@query(f"""WITH {SENT}, w AS (SELECT doc_id, sent_idx, list_distinct(regexp_extract_all(lower(text), '{WORD}')) AS ws FROM sent WHERE length(text) >= 30),
p AS (SELECT a.doc_id, a.sent_idx AS a, b.sent_idx AS b, len(list_intersect(a.ws, b.ws)) AS k, len(a.ws) AS na, len(b.ws) AS nb FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.sent_idx < b.sent_idx AND 0.89 * greatest(len(a.ws), len(b.ws)) <= least(len(a.ws), len(b.ws)) WHERE len(a.ws) > 0)
SELECT doc_id, a, b, round(k / (na + nb - k), 6) AS similarity FROM p WHERE round(k / (na + nb - k), 6) >= 0.9""")
def near_sentences(spark, sf_dir):
    return X.near_sentences(load(spark, sf_dir, "documents"))


FP = f"f AS (SELECT doc_id, sha256(coalesce(text, '')) AS full_hash, sha256(substr(coalesce(text, ''), 1, 1000)) AS start_hash, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS n_words, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM documents)"


@query(f"WITH {FP} SELECT * FROM f")
def fingerprints(spark, sf_dir):
    return X.fingerprints(load(spark, sf_dir, "documents"))


@query(f"""WITH {FP}, m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY full_hash) AS s, min(doc_id) OVER (PARTITION BY start_hash) AS l FROM f)
SELECT doc_id, CASE WHEN s < doc_id THEN s ELSE l END AS match_id, CASE WHEN s < doc_id THEN 'exact' ELSE 'start' END AS how FROM m WHERE s < doc_id OR l < doc_id""")
def fingerprint_matches(spark, sf_dir):
    return X.fingerprint_matches(load(spark, sf_dir, "documents"))


@query(f"""
WITH d AS (SELECT doc_id // 2 AS pair, doc_id % 2 AS side, list_distinct(regexp_extract_all(lower(text), '{WORD}')) AS ws, CASE WHEN length(text) >= 3 THEN list_distinct(list_transform(range(1, length(text) - 1), lambda i: substr(lower(text), i, 3))) ELSE [] END AS gs, length(lower(text)) AS n FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
j AS (SELECT a.pair, len(list_intersect(a.ws, b.ws)) AS wi, len(list_distinct(list_concat(a.ws, b.ws))) AS wu, len(list_intersect(a.gs, b.gs)) AS gi, len(list_distinct(list_concat(a.gs, b.gs))) AS gu, a.n AS n, b.n AS m FROM d a JOIN d b ON a.pair = b.pair AND a.side = 0 AND b.side = 1),
s AS (SELECT pair, 0.3::DOUBLE * CASE WHEN wu = 0 THEN 0 ELSE wi / wu END + 0.5::DOUBLE * CASE WHEN gu = 0 THEN 0 ELSE gi / gu END + 0.2::DOUBLE * (least(n, m) / greatest(n, m, 1)) AS score FROM j)
SELECT pair, round(score, 6) AS score, CASE WHEN score >= 0.78 THEN 'same' WHEN score <= 0.40 THEN 'different' ELSE 'uncertain' END AS kind FROM s""")
def version_identity(spark, sf_dir):
    return X.identity(load(spark, sf_dir, "documents"))


@query("""SELECT doc_id, CAST(CASE WHEN length(text) > 1000 THEN length(b) - length(replace(b, chr(10), '')) + 1 ELSE 1 END AS BIGINT) AS line,
  CAST(CASE WHEN length(text) > 1000 THEN len(list_filter(regexp_split_to_array(b, '[ \\n\\t\\r]+'), lambda w: w <> '')) // 300 + 1 ELSE 1 END AS BIGINT) AS page FROM (SELECT doc_id, text, substr(text, 1, 1000) AS b FROM documents)""")
def page_and_line(spark, sf_dir):
    return X.page_and_line(load(spark, sf_dir, "documents"))


@query(f"""WITH {PARAS}, o AS (SELECT doc_id, unnest(range(0, length(text), 700)) AS "offset" FROM documents WHERE length(text) > 0)
SELECT o.doc_id, o."offset", p.para_idx, o."offset" - p.start_char AS "local" FROM o ASOF JOIN paras p ON o.doc_id = p.doc_id AND o."offset" >= p.start_char""")
def offsets_to_paragraphs(spark, sf_dir):
    return X.offsets_to_paragraphs(load(spark, sf_dir, "documents"))


@query(f"""WITH {PARAS}, h AS (SELECT * FROM paras WHERE length(trim(text)) BETWEEN 1 AND 60 AND regexp_matches(text, '^[A-ZÁÉÍÓÚÑÄÖÜ]') AND NOT regexp_matches(text, '[.!?;:,]$'))
SELECT doc_id, para_idx, start_char, coalesce(lead(start_char) OVER (PARTITION BY doc_id ORDER BY para_idx), -1) AS section_end FROM h""")
def headings(spark, sf_dir):
    return X.headings(load(spark, sf_dir, "documents"))


_EPOCH = "CASE " + " ".join(f"WHEN first_year >= {a} AND last_year <= {b} THEN '{n}'" for n, a, b in sorted(L.PERIODS, key=lambda p: p[2] - p[1])) + " ELSE 'unknown' END"


@query(f"""WITH y AS (SELECT doc_id, CAST(unnest(regexp_extract_all(coalesce(text, ''), '\\b(\\d{{4}})\\b', 1)) AS BIGINT) AS y FROM documents),
g AS (SELECT doc_id, count(*) AS n, min(y) AS first_year, max(y) AS last_year FROM y WHERE y BETWEEN 1000 AND 2029 GROUP BY 1) SELECT *, {_EPOCH} AS epoch FROM g""")
def years_and_epochs(spark, sf_dir):
    return X.years(load(spark, sf_dir, "documents"))


@query(r"""WITH b AS (SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<script[^>]*>.*?</script>', '', 'g'), '(?s)<style[^>]*>.*?</style>', '', 'g'), '<p[ >]', chr(1), 'g'), chr(1)) AS ps FROM pages),
t AS (SELECT page_id, list_filter(list_transform(ps[2:], lambda p: trim(regexp_replace(regexp_replace(regexp_extract(p, '(?s)^(.*?)(?:</p>|$)', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))), lambda p: p <> '') AS ts FROM b),
u AS (SELECT page_id, unnest(range(len(ts))) AS para_idx, unnest(ts) AS x FROM t)
SELECT page_id, para_idx, CAST(length(x) AS BIGINT) AS n_chars, md5(x) AS digest FROM u""")
def html_paragraphs(spark, sf_dir):
    return X.html_paragraphs(load(spark, sf_dir, "pages"))


COS = "list_dot_product(list_transform({a}, lambda x: CAST(x AS DOUBLE)), list_transform({b}, lambda x: CAST(x AS DOUBLE))) / (sqrt(list_dot_product(list_transform({a}, lambda x: CAST(x AS DOUBLE)), list_transform({a}, lambda x: CAST(x AS DOUBLE)))) * sqrt(list_dot_product(list_transform({b}, lambda x: CAST(x AS DOUBLE)), list_transform({b}, lambda x: CAST(x AS DOUBLE)))))"


@query(f"""WITH v AS (SELECT vec_id, embedding AS e, lag(embedding) OVER (PARTITION BY vec_id // 50 ORDER BY vec_id) AS b FROM embeddings), s AS (SELECT vec_id, round({COS.format(a="e", b="b")}, 6) AS similarity FROM v WHERE b IS NOT NULL)
SELECT *, CASE WHEN similarity < 0.15 THEN 'high' WHEN similarity < 0.21 THEN 'medium' ELSE 'low' END AS severity FROM s WHERE similarity < 0.3""")
def neighbour_coherence(spark, sf_dir):
    return X.neighbour_coherence(load(spark, sf_dir, "embeddings"))


@query(f"""WITH p AS (SELECT x.vec_id AS a, y.vec_id AS b, x.embedding AS e, y.embedding AS f FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id AND y.vec_id - x.vec_id <= 100) SELECT a, b, round({COS.format(a="e", b="f")}, 6) AS similarity FROM p WHERE round({COS.format(a="e", b="f")}, 6) >= 0.4""")
def semantic_redundancy(spark, sf_dir):
    return X.semantic_redundancy(load(spark, sf_dir, "embeddings"))


@query("WITH e AS (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM embeddings) SELECT label, i, round(avg(CAST(x AS DOUBLE)), 6) AS mean, count(*) AS n FROM e GROUP BY 1, 2")
def label_centroids(spark, sf_dir):
    return X.label_centroids(load(spark, sf_dir, "embeddings"))


@query(f"""WITH {TOK}, g AS (SELECT lang, token_lc AS word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM tok JOIN documents USING (doc_id) GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS INT) AS rank FROM g QUALIFY rank <= 20""")
def token_statistics(spark, sf_dir):
    return X.token_statistics(load(spark, sf_dir, "documents"))


@query("""WITH j AS (SELECT n_chars < 500 AS f, quality = 0 AS t FROM documents JOIN labels USING (doc_id)), g AS (SELECT count(*) FILTER (f AND t) AS tp, count(*) FILTER (f AND NOT t) AS fp, count(*) FILTER (NOT f AND t) AS fn FROM j)
SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE round(tp / (tp + fn), 6) END AS recall FROM g""")
def label_quality(spark, sf_dir):
    return X.label_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
