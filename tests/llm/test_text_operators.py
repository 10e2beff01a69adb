"""Measures, scores and languages against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from adlift.llm import langid, quality, queries, toxicity

SF = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _measures(text):
    text = text or ""
    words = WORD.findall(text)
    seen, at = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i:i + 5]), []).append(i)
    for pos in seen.values():
        if len(pos) > 1:
            at |= {i + k for i in pos for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(at))


def test_quality_measures_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    extra = [(9001, None, "en", "s"), (9002, "", None, None), (9003, "a b c d e a b c d e a b c d e\n\n x \n x \n", "en", None),
             (9004, "é ü 日本 #x y %% <a>\x0bb\x1cc", "zz", "new"), (9003, "a b", "en", None)]
    df = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumn("n_words", F.lit(5)).withColumn("measure", F.lit(1))
    got = sorted((tuple(r)[:7] for r in quality.quality_verdicts(df).collect()), key=repr)
    want = []
    for r in df.collect():
        m = _measures(r["text"])
        want.append((r["doc_id"], *m, m[0] < 10 or 100 * m[4] > 20 * m[0]))
    assert got == sorted(want, key=repr)
    out = quality.quality_verdicts(df)
    assert out.where("base_failed and kept").count() == 0
    assert quality.quality_verdicts(df.limit(0)).count() == 0


def test_quality_thresholds_follow_the_group(spark):
    """The same symbol share passes in a group where it is usual and fails elsewhere."""
    def text(i, symbols):
        return " ".join(f"w{i}x{k}" + ("#" if k < symbols else "") for k in range(40))
    rows = [(i, text(i, 20 + i % 9), "en", "code") for i in range(100)] + [(100 + i, text(100 + i, 0), "en", "prose") for i in range(100)]
    rows += [(500, text(500, 24), "en", "code"), (501, text(501, 24), "en", "prose")]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[500] and not got[501]


def test_sketch_merge_is_exact(spark):
    m = quality.measures(spark.read.parquet(f"{SF}/documents.parquet"))
    whole = quality.merge(quality.sketches(m)).collect()
    parts = quality.merge(quality.merge(quality.sketches(m), "lang")).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts))


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(5)
    entries = [("idiot", False, 2.0), ("moron", False, 1.5), ("scum", False, 1.0), ("worthless", False, 3.0), ("morons", False, 1.0)]
    lex = toxicity.FuzzyLexicon(entries)
    words = [e[0] for e in entries]
    for _ in range(4000):
        w = list(rng.choice(words))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w) + 1)
            w[k:k + rng.randrange(2)] = [rng.choice("abdeiomnrst")] * rng.randrange(2)
        w = "".join(w)
        if not w:
            continue
        fits = [(d, -wt, i) for i, (t, _, wt) in enumerate(entries) if (d := _levenshtein(w, t)) <= toxicity.allowed_edits(len(t))]
        got = lex.match(w)
        assert (got is None) == (not fits), w
        if fits:
            assert (got[1], -entries[got[0]][2]) == min(fits)[:2], w


def test_stems_match_as_prefixes_and_quotes_weigh_less():
    lex = toxicity.FuzzyLexicon([("vequ", True, 2.0), ("idiot", False, 2.0)])
    assert lex.match("vequaire") == (0, 0) and lex.match("vexuaire") is None
    plain = toxicity.features(lex, "that is an idiot over there")
    quoted = toxicity.features(lex, 'he said "idiot" over there')
    assert plain[0] > quoted[0] > 0 and quoted[4] > 0 and plain[4] == 0
    assert toxicity.features(lex, None) == toxicity.features(lex, "") == [0.0] * len(toxicity.FEATURES)


def test_words_under_a_learned_stem_keep_their_edits(spark):
    kinds = ["worthless", "worthles", "worthlss", "worthlesser"]
    rows = [(i, f"you {kinds[i % 4]} thing number {i}", 1) for i in range(40)]
    rows += [(100 + i, f"a calm thing number {i}", 0) for i in range(200)]
    lex = toxicity.learn_lexicon(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert any(stem and "worthless".startswith(text) for text, stem, _ in lex.entries)
    assert lex.match("worthy") is not None and lex.match("worthless")[1] == 0
    for word in ("wrothless", "vorthless", "wrthless", "wortless", "worhtless"):
        m = lex.match(word)
        assert m is not None and lex.entries[m[0]][0] in (*kinds, "wort"), word
    assert lex.match("calm") is None and lex.match("vorth") is None


def test_toxicity_on_held_out_rows(spark):
    got = queries.op6_toxicity(spark, SF_MID).where("held_out")
    lab = spark.read.parquet(f"{SF_MID}/labels.parquet").select("doc_id", "toxic")
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", F.lower("text").contains("idiot").alias("plain"))
    rows = got.join(lab, "doc_id").join(docs, "doc_id").collect()
    assert len(rows) > 50
    assert all(r["predicted"] == 1 for r in rows if r["toxic"] == 1 and r["plain"])
    assert sum(r["predicted"] == 1 for r in rows if r["toxic"] == 0) <= 0.02 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, None), (None, "you idiot"), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(spark, docs, labels)
    assert [r["predicted"] for r in toxicity.score_toxicity(docs, model).collect()] == [0, 0, 0]
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_language_of_pages(spark):
    got = queries.op3_language_id(spark, SF_MID)
    pages = spark.read.parquet(f"{SF_MID}/pages.parquet").select("page_id", F.regexp_extract("url", "//[^/]+/([a-z]+)/", 1).alias("want"))
    rows = got.join(pages, "page_id").collect()
    assert len(rows) == pages.count()
    assert sum(r["language"] == r["want"] for r in rows) >= 0.98 * len(rows)


def test_evidence_decides_short_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit_trigrams(docs)
    rows = [(i, "und", "de", "h.de", "de") for i in range(30)] + [(99, "", "de", "h.de", "de"), (100, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string, suffix string").withColumn("p0", F.lit(1))
    got = {r["key"]: r for r in langid.identify_languages(df, model, "id", "text", F.col("declared"), F.col("host"), F.col("suffix")).collect()}
    assert len(got) == 32 and got[99]["language"] == got[0]["language"]
    assert math.isclose(sum(got[100]["posterior"]), 1.0) and 0 < got[100]["confidence"] <= 1
    assert langid.identify_languages(df.limit(0), model, "id", "text").count() == 0
    empty = langid.fit_trigrams(docs.limit(0))
    assert [r["language"] for r in langid.identify_languages(df.limit(1), empty, "id", "text").collect()] == [None]


def test_language_stage_rejects_junk_and_foreign_texts(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    bad = ["", None, "  ", "0123456789 " * 20, "%%% ### $$$ !!! ((())) " * 10, "3 14 15", "asdkjh qwoeiu zxmcnb qpwoei alskdj zmxncb",
           "Все люди рождаются свободными и равными в своем достоинстве и правах.", "すべての人間は、生まれながらにして自由である。",
           "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan."]
    rows = [(10 ** 9 + 10 * i + k, t, lang, "src0", len(t or "")) for i, t in enumerate(bad) for k, lang in enumerate(("en", "de", None))]
    got = {r[0] for r in corpus_pipeline.language_id(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), SF_MID)
           .select("doc_id").collect()}
    assert not [r for r in rows if r[0] in got]
    clean = {r[0] for r in docs.where("n_chars >= 40").select("doc_id").collect()}
    assert len(clean & got) >= 0.99 * len(clean)


@pytest.mark.parametrize("page,want", [("<p>a&amp;b</p>", "a&b"), (None, ""), ("<script>x</script>y", "y")])
def test_visible_text(page, want):
    assert langid.visible_text(page).strip() == want


def test_toxicity_fit_is_repeatable(spark):
    """Same model whatever the partitions, with copies under both labels and columns that clash."""
    word = [f"plain{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choices(word, k=12) + ["gromble"] * (i % 3 == 0)), i % 3 == 0) for i in range(240)]
    rows += [(1000 + i, "one and the same copied text again " + word[i % 2], i % 2 == 0) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string") \
        .withColumn("toxic", F.lit("x")).withColumn("low", F.lit(1)).withColumn("score", F.lit(0.5))
    labels = spark.createDataFrame([(r[0], int(r[2])) for r in rows], "doc_id long, toxic int")
    one = toxicity.fit_toxicity(spark, docs.coalesce(1), labels.coalesce(1))
    two = toxicity.fit_toxicity(spark, docs.repartition(7, "text"), labels.repartition(5))
    assert one.lexicon.entries == two.lexicon.entries and "gromble" in [e[0] for e in one.lexicon.entries]
    assert (one.coef, one.mean, one.scale) == (two.coef, two.mean, two.scale)
    got = toxicity.score_toxicity(docs, one).collect()
    texts = dict(r[:2] for r in rows)
    for r in got:  # the score again, feature by feature
        x = toxicity.features(one.lexicon, texts[r["doc_id"]])
        z = one.coef[0] + sum(c * (v - m) / s for c, v, m, s in zip(one.coef[1:], x, one.mean, one.scale, strict=True))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_held_out_of_a_null_key(spark):
    df = spark.createDataFrame([(None, "a"), (1, "b")], "doc_id long, text string")
    assert [r[0] for r in df.where("doc_id is null").select(toxicity.held_out()).collect()] == [False]
