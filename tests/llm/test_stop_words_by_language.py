"""The pipeline's stop-word rule binds only where a language has a list of stop words."""

import corpus_pipeline

RUSSIAN = "Старый рыбак вышел рано утром в море, чтобы проверить сети, которые он поставил вчера вечером около скал. Ветер был слабый, волны тихо бились о борт лодки."
NONE = "Xorvat bilmas quvnoq tilni sekin yozadi kuchli daryo ustida katta qush uchib ketdi yana qaytib keldi uzoq tog yonida kichik uy turadi bugun"


def test_documents_without_a_list_pass(spark):
    rows = [(1, RUSSIAN, "ru"), (2, RUSSIAN, None), (3, NONE, "uz"), (4, NONE, "en"), (5, NONE, "de-AT"), (6, NONE, "FR_ca"), (7, f"{NONE} the of and", "en"), (8, "!!! ??? " * 30, "ru"), (9, None, "ru")]
    docs = spark.createDataFrame([(i, t, g, "a", None) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, "").collect()} == {1, 2, 3, 7}
