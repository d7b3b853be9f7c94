"""The numbered queries and the pipeline over the bundled tables."""

import duckdb
import pytest

from gridspark.llm.oracles import ORACLES
from gridspark.llm.queries import QUERIES

from oracle import connect, differences


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLES)))
def test_against_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) == ""


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert len(corpus_pipeline.STAGES) == 5 and {r.doc_id for r in got} <= {r.doc_id for r in docs.select("doc_id").collect()}
    held = {}
    for r in got:
        held[r.sequence_id, r.capacity] = held.get((r.sequence_id, r.capacity), 0) + r.n_tokens
    assert got and all(n <= c for (_, c), n in held.items())


def test_license_scan_does_all_of_it(spark, tmp_path):
    """Rows without id, and how many windows hold a notice: what a smaller SQL had left out."""
    from gridspark.llm.licenses import TEMPLATES

    grant, filler = TEMPLATES["mit-grant"], " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"{filler} {grant} {filler} {grant}"), (None, grant), (3, " ".join(grant.split()[:9] + filler.split() + grant.split()[9:])), (3, grant), (4, filler), (None, None), (5, "mit")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    frame = QUERIES["op10_license_scan"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert differences(frame, con, ORACLES["op10_license_scan"]) == ""
    got = {(r.doc_id, r.license): r for r in frame.collect()}
    assert got[None, "mit-grant"].containment == 1.0 and got[1, "mit-grant"].n_windows >= 2 and got[1, "mit-grant"].first_window <= got[1, "mit-grant"].first_word
