"""Languages of documents that a sample of 2,000 rows a fold would not have held."""

import hashlib

from veristrata import catalog
from veristrata.operators import learned as L


def test_language_id_is_fitted_on_all_rows(spark, tmp_path, monkeypatch):
    # rows with hashes beyond the share of a sample are those of the language zz
    last = lambda i: int(hashlib.md5(f"sample:{i}".encode()).hexdigest()[:12], 16) / 2**48 > 0.97
    rows = [(i, "zz", "zuzu zaza") if last(i) else (i, "xx", "aba baba") if i % 2 else (i, "yy", "dodo odo") for i in range(5200)]
    spark.createDataFrame(rows, "doc_id bigint, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    gold = {i: lang for i, lang, _ in rows}
    for exact in (L.EXACT_ROWS, 0):
        monkeypatch.setattr(L, "EXACT_ROWS", exact)
        found = catalog.QUERIES["language_id"](spark, str(tmp_path)).collect()
        assert len(found) == len(rows) and all(r.lang == gold[r.doc_id] for r in found)
