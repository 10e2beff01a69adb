"""Stages of the pipeline decide row by row."""

import pytest
from pyspark.sql import functions as F

from adlift.llm.store import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    """The documents with rows whose ids repeat or are null, and columns of names used within."""
    d = table(spark, SF, "documents")
    a = d.where("length(text) > 400").orderBy("doc_id").limit(3).collect()
    junk = "12 34 %% 777 ... 99 ### 1010 -- 5 && 7 = 8 + 9 / 4 ;; 22 @@ 31"
    more = [(a[0]["doc_id"], junk, None, "s"), (None, a[1]["text"], "en", "s"), (None, a[1]["text"], "en", "s"), (None, None, None, None),
            (-5, a[2]["text"], a[2]["lang"], None), (-5, a[2]["text"], a[2]["lang"], None), (-6, "", "en", "s")]
    more = spark.createDataFrame(more, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    d = d.unionByName(more.select([F.col(c).cast(t) for c, t in d.dtypes]))
    return d.withColumns({c: F.lit("x") for c in ("k", "toxic", "row", "Row_", "cls", "n", "token", "component_id")})


def _same_columns(docs, out):
    assert out.columns == docs.columns


def test_language_stage(spark, docs):
    import corpus_pipeline as P
    out = P.language_id(spark, docs, SF)
    _same_columns(docs, out)
    rows = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert all(t for _, t in rows) and not any(t and t.startswith("12 34") for _, t in rows)
    first = docs.where("length(text) > 400 and doc_id >= 0").orderBy("doc_id").first()
    assert (first["doc_id"], first["text"]) in rows  # its namesake goes alone
    assert sum(d is None for d, _ in rows) == 2 and sum(d == -5 for d, _ in rows) == 2


def test_toxicity_stage(spark, docs):
    import corpus_pipeline as P
    mid = "/root/testdata/sf0.01"  # the small table has too few labels to learn from
    known = table(spark, mid, "documents").withColumns({c: F.lit("x") for c in ("k", "toxic", "row", "Row_", "cls", "n", "token", "component_id")})
    stay = {r["doc_id"] for r in P.toxic(spark, known, mid).select("doc_id").collect()}
    text = known.where(~F.col("doc_id").isin(stay)).orderBy("doc_id").first()["text"]
    more = docs.where("doc_id = -5 or doc_id is null")
    twin = more.limit(1).withColumn("doc_id", F.lit(-5).cast("long")).withColumn("text", F.lit(text))
    out = P.toxic(spark, known.unionByName(more).unionByName(twin), mid)
    _same_columns(docs, out)
    rows = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sum(d == -5 for d, _ in rows) == 2 and (-5, text) not in rows and (None, None) in rows and sum(d is None for d, _ in rows) == 3


def test_near_copies_stage(spark, docs):
    import corpus_pipeline as P
    out = P.near_copies(spark, docs, SF)
    _same_columns(docs, out)
    rows = [(r["doc_id"], r["text"]) for r in out.collect()]
    texts = [" ".join((t or "").lower().split()) for _, t in rows]
    assert len({t for t in texts if t}) == len([t for t in texts if t])  # one row of each text with words
    assert texts.count("") == docs.where("text is null or trim(text) = ''").count()
    assert sum(d == -5 for d, _ in rows) == 1  # the smaller id stays, on one of its equal rows
    a = docs.where("length(text) > 400 and doc_id >= 0").orderBy("doc_id").limit(3).collect()
    assert (a[1]["doc_id"], a[1]["text"]) in rows and (None, a[1]["text"]) not in rows and (a[2]["doc_id"], a[2]["text"]) not in rows


def test_empty_table(spark, docs):
    import corpus_pipeline as P
    none = docs.limit(0)
    for _, stage in P.STAGES[:4]:
        out = stage(spark, none, SF)
        _same_columns(none, out)
        assert out.count() == 0


def test_stages_that_judge_a_text_write_no_copy_of_their_input(spark, docs, monkeypatch):
    import corpus_pipeline as P
    from adlift.llm import langid
    names = []
    for module in (P, langid):
        monkeypatch.setattr(module, "written", lambda df, name, f=P.written: (names.append((name, df.columns)), f(df, name))[1])
    for stage in (P.language_id, P.toxic):
        _same_columns(docs, stage(spark, docs, SF))
    assert names and not any("text" in columns for _, columns in names)
