import hashlib

import __spark_entry__ as entry
from tests.conftest import SMALL


def test_long_abstracts_are_cut_and_marked(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    want = {i: t if len(t) <= 1000 else t[:1000] + b"..." for i, t in docs.items()}
    out = entry.queries()["abstracts_of_documents"](spark, SMALL).selectExpr("doc_id", "cast(abstract as binary) AS b").collect()
    assert {r.doc_id: bytes(r.b) for r in out} == want and len(out) == len(docs)
    assert any(len(t) == 1003 for t in want.values())


def test_index_and_back_keep_null_repeated_and_spaced_documents_and_shuffle_no_words(spark, tmp_path):
    texts = ["a b a", "", " ", "  a  ", None, "é a é b  é", "a b a", "w " * 700]
    spark.createDataFrame([(i % 7, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = [(i % 7, t if t is None or len(t) <= 1000 else t[:1000] + "...") for i, t in enumerate(texts)]
    run = entry.queries()
    whole = run["abstracts_of_documents"](spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted((i, t or "") for i, t in want)
    short = run["abstract_round_trip"](spark, str(tmp_path))
    assert sorted(map(tuple, short.collect()), key=repr) == sorted(((i, t if t is None or len(t) <= 1000 else None) for i, t in want), key=repr)
    cuts = run["abstract_cuts"](spark, str(tmp_path))
    assert sorted(map(tuple, cuts.collect())) == sorted((i, len(b), hashlib.md5(b).hexdigest()) for i, t in want for b in [(t or "").encode()])
    assert not any("Generate explode" in p or "Generate posexplode" in p or "Join" in p for p in (d._jdf.queryExecution().optimizedPlan().toString() for d in (whole, short, cuts)))
