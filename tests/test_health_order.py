"""Chapters of one mean tone, whose sums of doubles differ by the order of rows."""

from tests.comparing import query_and_oracle

LINE = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_discount double, l_linestatus string"


def test_tones_are_added_in_the_order_of_the_table(spark, tmp_path):
    tones = {1: (6, 7, 8, 2, 6), 2: (8, 2, 7, 6, 6), 3: (7, 8, 6, 6, 2), 4: (2, 6, 6, 7, 8), 5: (6, 2, 8, 6, 7), 6: (9,)}
    rows = [(100 * story + (91 * k + 7 * story) % 100, (c + story) % 6 + 1, 1, 2, t / 100, "O") for story in range(6) for c, ts in tones.items() for k, t in enumerate(ts)]
    spark.createDataFrame(rows, LINE).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got, want = query_and_oracle(spark, tmp_path, "narrative_health", ("lineitem",))
    assert got == want and len({r[-2] for r in got}) > 1
