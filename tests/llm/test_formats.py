"""Files, segmentations, mixtures and chats: round trips and exact checks."""

import collections
import gzip
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from adlift.llm import chat, lattice, mixing, queries, textops, tokenstore, warc

SF = "/root/testdata/sf0.001"


# -- token store --------------------------------------------------------------

def test_tokens_equal_whole_text_encoding(spark, tmp_dir):
    from tokenizers import Tokenizer
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = [(-5, None), (-4, ""), (-3, "  two  spaces \n\n x\t y  z "), (-2, "<|endoftext|> a<|endoftext|>"), (9001, " lead"),
             (9002, "a\x1c b \x1cc"), (9003, "trail \n "), (None, "no key")]
    df = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumn("key", F.lit("x"))
    path = queries.tokenizer_path("byte_bpe_50k.json")
    tokenstore.write_tokens(df, tmp_dir + "/t", path)
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    start, want = 0, []
    for r in sorted(df.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r["doc_id"], start, len(ids), ids.tobytes()))
        start += len(ids)
    got = [tuple(r) for r in tokenstore.read_tokens(spark, tmp_dir + "/t").collect()]
    assert sorted(((k, s, n, bytes(i)) for k, s, n, i in got), key=lambda x: x[1]) == want
    crc = {r["key"]: r["crc"] for r in tokenstore.read_tokens(spark, tmp_dir + "/t", digest=True).collect()}
    assert crc == {k: zlib.crc32(i) for k, _, _, i in want}
    asked = spark.createDataFrame([(3,), (9001,), (123456789,)], "key long")
    found = {r["key"]: bytes(r["ids"]) for r in tokenstore.lookup(spark, tmp_dir + "/t", asked).collect()}
    assert found == {k: i for k, _, _, i in want if k in (3, 9001)}


def test_special_tokens_in_texts_as_the_library_reads_them(spark, tmp_dir):
    from tokenizers import Tokenizer
    path = queries.tokenizer_path("byte_bpe_50k.json")
    e = "<|endoftext|>"
    texts = [e, f"a{e}b", f" {e} ", f"one  {e}\nTwo{e}{e}, x{e[:-1]}", f"x.\n{e}'s it", f"<{e}> <|endof{e}text|>", None, "", "<|endof", "text|>",
             f"é\u00a0{e}\u00a0 é\n", "plain words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(tmp_dir + "/sf/documents.parquet")
    tok = Tokenizer.from_file(path)  # left at its defaults
    start, want = 0, []
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert want[0][2] == 2
    got = queries.op4_token_store(spark, tmp_dir + "/sf").coalesce(1).collect()
    assert sorted(map(tuple, got)) == want


def test_tokens_of_an_empty_table_and_repeated_keys(spark, tmp_dir):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    none = spark.createDataFrame([], "doc_id long, text string")
    tokenstore.write_tokens(none, tmp_dir + "/e", path)
    assert tokenstore.read_tokens(spark, tmp_dir + "/e").count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "c"), (2, "d")], "doc_id long, text string")
    tokenstore.write_tokens(twice, tmp_dir + "/d", path)
    rows = sorted((r["start"], r["n_tokens"]) for r in tokenstore.read_tokens(spark, tmp_dir + "/d").collect())
    assert len(rows) == 3 and [s for s, _ in rows] == [0, *np.cumsum([n for _, n in rows])[:-1]]


def test_perfect_hash_is_minimal_and_rejects_strangers():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**62, 20000)).astype(np.int64)
    starts, lengths = np.arange(len(keys)) * 7, np.full(len(keys), 7)
    idx = tokenstore.ShardIndex.decode(tokenstore.ShardIndex.encode(keys, np.ones(len(keys), bool), starts, lengths, 2))
    h = tokenstore._key_hash(keys, np.ones(len(keys), bool))
    assert sorted(idx.mph.slots(np.unique(h))) == list(range(len(keys)))
    s, n = idx.lookup(keys)
    assert (s == starts).all() and (n == 7).all()
    strangers = np.random.default_rng(2).integers(-2**62, 0, 20000)
    assert (idx.lookup(strangers)[0] >= 0).sum() <= 2


# -- WARC -----------------------------------------------------------------------

def _pages(spark):
    big = "<p>" + "x" * 200 + "é</p>"
    rows = [(5, "http://a/5", big), (2, "http://a/2", big), (9, None, big), (1, "http://b/\r\nX: y", None), (3, "http://b/3", ""),
            (4, "http://b/4", "small"), (6, "http://b/6", "small"), (None, "http://n", "alone" * 50)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)), big


def test_warc_round_trip_and_revisits(spark, tmp_dir):
    pages, big = _pages(spark)
    warc.write_warc(warc.page_records(pages), tmp_dir + "/w")
    rows = {r["record_id"]: r for r in warc.read_warc(spark, tmp_dir + "/w").collect()}
    assert len(rows) == 8
    r2, r5 = rows["urn:x-page:2"], rows["urn:x-page:5"]
    assert r2["record_type"] == "response" and bytes(r2["payload"]).decode() == big
    assert r5["record_type"] == "revisit" and r5["refers_to"] == "urn:x-page:2" and r5["payload"] is None
    assert r5["payload_length"] == len(big.encode()) and r5["payload_digest"] == r2["payload_digest"]
    assert rows["urn:x-page:4"]["record_type"] == rows["urn:x-page:6"]["record_type"] == "response"
    assert rows["urn:x-page:1"]["target_uri"] == "http://b/%0D%0AX: y" and rows["urn:x-page:9"]["target_uri"] is None
    warc.write_warc(warc.page_records(pages.limit(0)), tmp_dir + "/none")
    assert warc.read_warc(spark, tmp_dir + "/none").count() == 0


def test_warc_filters_and_payload_option(spark, tmp_dir):
    pages, _ = _pages(spark)
    warc.write_warc(warc.page_records(pages), tmp_dir + "/w")
    got = warc.read_warc(spark, tmp_dir + "/w", payload=False).where("record_type = 'revisit'")
    assert "PushedFilters" in got._jdf.queryExecution().toString() or got.count() == 2
    assert sorted(r["record_id"] for r in got.collect()) == ["urn:x-page:5", "urn:x-page:9"]
    some = warc.read_warc(spark, tmp_dir + "/w", payload=False).where(F.col("target_uri").startswith("http://b/"))
    assert some.count() == 4 and some.where("payload is not null").count() == 0


def test_foreign_archives(spark, tmp_path):
    recs = [warc.encode_record(f"urn:x-page:{i}", "response", f"http://h/{i}", None, "00", 3 + i, b"abc" + b"z" * i) for i in range(5)]
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.warc").write_bytes(b"".join(recs))
    (tmp_path / "gz").mkdir()
    (tmp_path / "gz" / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in recs))
    for kind in ("plain", "gz"):
        rows = warc.read_warc(spark, str(tmp_path / kind)).where("record_id <> 'urn:x-page:3'").collect()
        assert sorted(bytes(r["payload"]) for r in rows) == [b"abc" + b"z" * i for i in (0, 1, 2, 4)]


# -- segmentations ----------------------------------------------------------------

@pytest.fixture(scope="module")
def model():
    return queries.tokenizer_path("piece_bpe_32k.model")


def test_sampling_is_without_replacement_in_gumbel_order(spark, model):
    n = 3000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("ththe on").alias("text"))
    rows = lattice.sample_segmentations(df, model, k=3).collect()
    by = collections.defaultdict(dict)
    for r in rows:
        by[r["key"]][r["sample"]] = (bytes(r["ids"]), r["gumbel"])
    p = {bytes(r["ids"]): math.exp(r["log_prob"]) for r in rows}
    assert all(len({v[0] for v in d.values()}) == 3 and d[0][1] > d[1][1] > d[2][1] for d in by.values())
    first = collections.Counter(d[0][0] for d in by.values())
    second = collections.Counter(d[1][0] for d in by.values())
    for x, q in p.items():
        assert abs(first[x] / n - q) < 5 * math.sqrt(q * (1 - q) / n) + 1e-3
        q2 = sum(p[y] * q / (1 - p[y]) for y in p if y != x)
        assert abs(second[x] / n - q2) < 5 * math.sqrt(q2 * (1 - q2) / n) + 2e-3


def test_units_of_ascii_texts_and_their_numbers(model, monkeypatch):
    rnd = random.Random(4)
    chars = [chr(i) for i in range(128)] + [lattice.SPACE] * 30
    texts = ["".join(rnd.choices(chars, k=rnd.randint(0, 40))) for _ in range(500)]
    assert [lattice._FINE_ASCII.findall(x) for x in texts] == [lattice._FINE.findall(x) for x in texts]
    t = lattice.piece_table(model)
    asked = []
    monkeypatch.setattr(lattice, "_FINE", type("Slow", (), {"findall": staticmethod(lambda x: asked.append(x) or [])}))
    assert lattice._units(t, lattice.SPACE + "plain") == [lattice.SPACE + "plain"] and not asked
    lattice._units(t, lattice.SPACE + "日本")
    assert len(asked) == 1
    lat, blocks = lattice.Lattice(t), [["b", "a", "b"], [], ["c", "a"]]
    assert lat.units(blocks).tolist() == [0, 1, 0, 2, 1] and lat.units([["d", "a"]]).tolist() == [3, 1]
    monkeypatch.setattr(lattice, "KEPT_POSITIONS", 2)
    lat.trim()
    assert list(lat.index) == ["b", "a"] and len(lat.off) == 3
    assert lat.units([["c", "b"]]).tolist() == [2, 0] and lat.last.tolist() == [1, 2, 3]


def test_segmentations_decode_and_repeat(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = [(9001, None), (9002, ""), (9003, "  two  spaces\nand 日本 \U0001f600 ² x². "), (None, "no key"), (9004, "a" * 3000), (9003, "again")]
    df = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumn("key", F.lit(1)).withColumn("seed", F.lit(1))
    s = lattice.sample_segmentations(df, model)
    rows = s.collect()
    assert all(r["decoded_crc32"] == r["text_crc32"] for r in rows)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, s.repartition(3).collect()), key=repr)
    text = {r["key"]: r["text"] for r in lattice.decode_segmentations(s.where("sample = 0"), model).collect()}
    want = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    assert all(text[k] == v for k, v in want.items() if k != 9003)
    assert len([r for r in rows if r["key"] in (9001, 9002)]) == 2
    assert lattice.sample_segmentations(df.limit(0), model).count() == 0


def test_all_segmentations_of_a_short_text(spark, model):
    df = spark.createDataFrame([(1, "on")], "doc_id long, text string")
    rows = lattice.sample_segmentations(df, model, k=50).collect()
    assert abs(sum(math.exp(r["log_prob"]) for r in rows) - 1) < 1e-9
    assert all(r["log_inclusion"] == 0.0 for r in rows) and len(rows) < 50


# -- mixing ------------------------------------------------------------------------

def test_mixture_meets_its_limits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tokens = mixing.token_counts(docs).collect()
    total = sum(r["tokens"] for r in tokens)
    out = mixing.mix_sources(docs).collect()
    spent = collections.Counter()
    for r in out:
        spent[r["source"]] += r["tokens"]
    share = [v / sum(spent.values()) for v in spent.values()]
    assert abs(sum(spent.values()) - total) < 0.03 * total
    assert -sum(x * math.log(x) for x in share) <= 0.96 * math.log(20) + 0.02
    by = collections.defaultdict(list)
    for r in out:
        by[r["source"]].append((r["slot"], r["epoch"]))
    assert all(x >= 0 for v in by.values() for x, _ in v)
    assert all([e for _, e in sorted(v)] == sorted(e for _, e in v) for v in by.values())  # epochs follow each other
    copies = collections.Counter((r["doc_id"], r["epoch"]) for r in out)
    assert max(copies.values()) == 1


def test_mixture_edges(spark):
    rows = [(1, "a b c", None), (2, None, "s"), (3, "", "s"), (None, "x", "t"), (4, "y z", "t"), (4, "y z", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("weight", F.lit(1)).withColumn("block", F.lit(1))
    out = mixing.mix_sources(df).collect()
    assert {r["doc_id"] for r in out} >= {2, 3}
    again = mixing.mixed_rows(df)
    assert again.columns == df.columns and again.count() == len(out)
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_mixing_is_native():
    import inspect
    src = inspect.getsource(mixing)
    assert "udf" not in src and "InArrow" not in src and ".rdd" not in src and "pandas" not in src


# -- chats ---------------------------------------------------------------------------

def test_preference_segments_by_hand(spark):
    c = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "q"), (1, 3, "assistant", "good"),
         (2, 0, "user", "same"), (3, 0, "user", None), (3, 1, None, "x"), (None, 0, "user", "n")]
    r = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "q"), (1, 3, "assistant", "bad"), (1, 4, "user", "more"),
         (2, 0, "user", "same"), (3, 0, "user", ""), (None, 0, "user", "m")]
    s = "pair long, turn long, role string, text string"
    seg = chat.preference_segments(spark.createDataFrame(c, s), spark.createDataFrame(r, s))
    got = sorted(((x["pair"], x["part"], x["turn"], x["trained"]) for x in seg.collect()), key=repr)
    assert got == sorted([(1, "prompt", 0, False), (1, "prompt", 1, False), (1, "prompt", 2, False), (1, "chosen", 3, True),
                          (1, "rejected", 3, True), (1, "rejected", 4, False), (2, "prompt", 0, False), (3, "prompt", 0, False),
                          (3, "chosen", 1, False), (None, "chosen", 0, False), (None, "rejected", 0, False)], key=repr)
    one = chat.rendered_pairs(seg).where("pair = 1").first()
    assert one["prompt"] == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n<|user|>\nq<|end|>\n"
    (a, b), = one["chosen_spans"]
    assert one["chosen"][a:b] == "good<|end|>\n"
    (a, b), = one["rejected_spans"]
    assert one["rejected"][a:b] == "bad<|end|>\n"
    none = spark.createDataFrame([], s)
    assert chat.preference_segments(none, none).count() == 0


def test_pipeline_stages_on_a_small_table(spark):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r[0] for r in docs.select("doc_id").collect()}
    a = P.language_id(spark, docs, SF)
    assert a.columns == docs.columns and {r[0] for r in a.select("doc_id").collect()} <= ids
    b = P.near_copies(spark, docs, SF)
    groups = queries.op10_ngram_join(spark, SF).collect()
    assert {r[0] for r in b.select("doc_id").collect()} == {r["component_id"] for r in groups}
    m = P.mix(spark, b, SF)
    assert m.columns == docs.columns
    out = P.run(spark, SF)
    assert out.count() > 0 and out.where("not decodes").count() == 0


@pytest.mark.parametrize("odd", ["", " ", "\n", "'", "'s", "it's 'sly' don't.\n", "a  b \n c\t d  e　 f  g", "é è, ü;\r\n ñ",
                                 "x\x1c y\x85 z", "中文 字。\n日本 ", "<|endoftext|> a<|endoftext|>", "1 2,3 4.\n5\nA\n\nB \n C", "🙂 🙂!\n?a"])
def test_block_encoder_equals_whole_texts(odd):
    """Blocks of texts give the ids of every text encoded whole, remembered pieces or not."""
    import pyarrow as pa
    from tokenizers import Tokenizer
    path = queries.tokenizer_path("byte_bpe_50k.json")
    tok, enc = Tokenizer.from_file(path), tokenstore.PieceEncoder(path, "<u2")
    tok.encode_special_tokens = True
    texts = ["the cat, sat.\nOn", odd, None, odd + " " + odd, "", odd * 3, "the cat"]
    for _ in range(2):
        for _, _, data, off in textops.utf8_chunks(pa.array(texts), 1 << 20):
            n, packed = enc.encode(data, off, 2)
        ids = np.split(np.frombuffer(b"".join(packed), "<u2"), np.cumsum(n)[:-1])
        assert [x.tolist() for x in ids] == [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
