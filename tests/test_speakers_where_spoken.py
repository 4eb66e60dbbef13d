"""Only texts that hold speech are searched for mentions."""

from fabula.operators import speakers as S


def test_texts_without_speech_are_not_searched(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Ana Ruiz calla."), (2, "Ana Ruiz miró.\n—Hola —dijo Ana Ruiz."), (3, None), (4, "Vino: «ya» de Ana Ruiz")], "doc_id long, text string")
    cast = spark.createDataFrame([(1, "Ana Ruiz", ["Ana"])], "entity_id long, name string, aliases array<string>")
    searched, find = [], S.find_mentions
    monkeypatch.setattr(S, "find_mentions", lambda d, e: searched.extend(r.doc_id for r in d.collect()) or find(d, e))
    rows = {(r.doc_id, r.dlg_idx, r.speaker_id) for r in S.speakers(docs, cast).collect()}
    assert sorted(searched) == [2, 4] and rows == {(2, 0, 1), (4, 0, 1)}
