"""The pipeline's stages, each against plain Python on a small table with odd rows and clashing column names."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridspark.llm import langid, mixing, packing, storage
from test_operators import best_of, classes, odd_rows, repeated_words, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies int, clean string, changed boolean, _again int, again int, text_hash string, rest string, rid long, removed string, id long, `a.b` string"


def documents(spark, rows):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, "web", None if t is None else len(t), 5, "c", True, 9, 9, "h", "r", 3, "x", 8, "dot") for i, t, lang in rows], SCHEMA).repartition(3)


def plain(rows):
    r = random.Random(31)
    some = [(i, t, "en") for i, t in rows]
    return some + [(500 + k, " ".join(r.choice(v) for _ in range(80)), lang) for k in range(60) for lang, v in [("en", words(300, 61)) if k % 2 else ("de", words(300, 62))]]


@pytest.fixture(scope="module")
def table(spark):
    return documents(spark, plain([*odd_rows(), (None, "no id at all")]))


@pytest.fixture(scope="module")
def labels(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("labels"))
    spark.createDataFrame([(500 + k, k % 3 > 0, k % 7 == 0) for k in range(60)], "doc_id long, q boolean, t boolean").select("doc_id", F.col("q").cast("int").alias("quality"), F.col("t").cast("int").alias("toxic")).write.parquet(f"{at}/labels.parquet")
    return at


def same_columns(got, docs):
    assert got.columns == docs.columns and [f.dataType for f in got.schema.fields] == [f.dataType for f in docs.schema.fields]
    rows = got.collect()
    assert all((r.copies, r.clean, r.changed, r._again, r.again, r.text_hash, r.rest, r.rid, r.removed, r.id, r["a.b"]) == (5, "c", True, 9, 9, "h", "r", 3, "x", 8, "dot") for r in rows)
    return rows


def test_language_stage(spark, table):
    got = same_columns(corpus_pipeline.language_id(spark, table, ""), table)
    rows = [r for r in table.collect() if r.doc_id is not None]
    keyed = spark.createDataFrame([(k, r.text, r.lang) for k, r in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.fit(table.select(F.struct("doc_id", F.xxhash64("text").alias("text_hash_")).alias("doc_id"), "text", "lang").filter("doc_id.doc_id is not null"))
    found = {r.doc_id: r for r in langid.predict(keyed, model).collect()}
    want = [r for k, r in enumerate(rows) if found[k].lang_pred != "und" and found[k].score >= corpus_pipeline.LEAST_SHARE]
    assert sorted((r.doc_id, r.text) for r in got) == sorted((r.doc_id, r.text) for r in want)
    assert {r.doc_id for r in got} >= {1, 2, 3, 9, 10, 12, *range(500, 560)} and not {4, 5, 6} & {r.doc_id for r in got}
    assert sum(r.doc_id == 9 for r in got) == 2


def test_near_dedup_stage(spark, table):
    got = same_columns(corpus_pipeline.near_dedup(spark, table, ""), table)
    rows = [(r.doc_id, r.text) for r in table.collect() if r.doc_id is not None]
    want = {i for i, (_, c) in classes(rows).items() if i == c}
    assert sorted(r.doc_id for r in got) == sorted(want)


def test_suffix_stage(spark, table):
    extra = plain([(700 + k, " ".join(words(60, 300 + k) + words(70, 99) + words(30, 400 + k))) for k in range(4)])
    docs = documents(spark, [*extra, *[(i, t, "en") for i, t in odd_rows() if i != 9], (None, "x", "en")])
    got = {r.doc_id: r for r in same_columns(corpus_pipeline.suffix_dedup(spark, docs, ""), docs)}
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect() if r.doc_id is not None)
    gone = repeated_words(rows)
    for i, t in rows:
        left = [w for p, w in enumerate(t.split()) if p not in gone[i]]
        if left or not gone[i]:
            assert (got[i].text or "").split() == left and got[i].n_chars == (len(got[i].text) if got[i].text is not None else None)
        else:
            assert i not in got
    assert len(gone[702]) >= 70 and not any(gone[i] for i in range(500, 560))


def test_mixing_stage(spark, table, labels):
    got = same_columns(corpus_pipeline.mix_domains(spark, table, labels), table)
    rates = mixing.mix(table, mixing.quality_domains(spark.read.parquet(f"{labels}/labels.parquet"))).collect()
    want = sorted(r.doc_id for r in rates for _ in range(r.copies) if r.doc_id is not None)
    assert sorted(r.doc_id for r in got) == want and {4, 5, 6} <= set(want)


def test_packing_stage(spark, table):
    got = corpus_pipeline.pack_sequences(spark, table, "").collect()
    rows = sorted((r.doc_id, len([w for w in re.split("[ \n\t\r]", r.text or "") if w])) for r in table.collect() if r.doc_id is not None)
    _, want = best_of([n for _, n in rows], packing.LENGTHS, packing.sequence_cost)
    assert sorted((r.doc_id, r.piece, r.n_tokens, r.sequence_id, r.capacity, r.opened) for r in got) == sorted((rows[item][0], piece, n, b, c, o) for item, piece, n, b, c, o in want)


@pytest.mark.parametrize("n", range(5))
def test_stages_on_an_empty_table(spark, table, labels, n):
    assert corpus_pipeline.STAGES[n][1](spark, table.limit(0), labels).count() == 0


def test_whole_run(spark, tmp_path):
    """Copies, near copies, a shared passage and texts without words go; clean documents come through with all their words."""
    shared = words(60, 77)
    clean = {i: t for i, t, _ in plain([]) if i >= 500}
    rows = [(i, t, lang) for i, t, lang in plain([])] + [
        (1, clean[500], "de"), (2, clean[501] + " more", "en"), (600, " ".join(words(50, 501) + shared), "en"), (601, " ".join(words(50, 502) + shared + words(9, 503)), "en"), (602, None, "en"), (603, "12 34", "en"),
    ]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in clean] + [(600, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    before = storage.mark()
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = {}
    for r in got:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
    kept = {i: n for i, n in tokens.items() if i in clean}
    assert set(clean) - set(kept) <= {500, 501} and all(n == 80 for n in kept.values())
    assert {1, 2} <= set(tokens) and not {602, 603} & set(tokens) and tokens.get(601, 59) == 59
    storage.release(before)
