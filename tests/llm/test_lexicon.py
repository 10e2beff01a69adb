"""The automaton lexicon against the tokenizers library."""

import random

import numpy as np
import pyarrow as pa
import pytest

from adlift.llm import lexicon
from adlift.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


def _automaton(words):
    words = sorted(words)
    return words, lexicon.Automaton(lexicon.compile_automaton(words, [[i, i + 1] for i in range(len(words))]))


def _minimal_states(words):
    """States of the smallest automaton: the distinct sets of suffixes that remain after a prefix."""
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)} | {b""}
    return len({frozenset(w[len(p):] for w in words if w.startswith(p)) for p in prefixes})


def test_automaton_is_minimal_and_numbers_its_words():
    rng = random.Random(3)
    words = {bytes(rng.choices(b"abc", k=rng.randint(1, 7))) for _ in range(300)}
    words |= {w + b"ing" for w in words} | {w + b"ed" for w in words}
    words, a = _automaton(words)
    assert a.n_states == _minimal_states(words)
    others = [w + b"x" for w in words] + [w[:-1] for w in words] + [b"", b"zz", b"\xff"]
    asked = words + others
    data = np.frombuffer(b"".join(asked), np.uint8)
    got = a.ordinals(data, np.cumsum([0, *map(len, asked)]))
    place = {w: i for i, w in enumerate(words)}
    assert got.tolist() == [place.get(w, -1) for w in asked]
    assert [a.ids[a.off[i]:a.off[i + 1]].tolist() for i in range(len(words))] == [[i, i + 1] for i in range(len(words))]


def test_empty_automaton():
    _, a = _automaton([])
    assert a.ordinals(np.frombuffer(b"abc", np.uint8), np.array([0, 3])).tolist() == [-1]


TEXTS = ["", None, " ", "\n\n  \t x", "it's we'll DON'T 'tis", "<|endoftext|>", "a<|endoftext|>b  <|endoftext|> <|endoftext|", "  <|endoftext|>  ",
         "naïve café ñandú 東京　タワー  x", "🙂🙂 👩‍👩‍👧 é", "x" * 300_000, "word " * 50_000, "1234567890 3.14 a1b2", " \u0085end", "�\x00\x7f",
         "tab\tand\r\nline\r\n\r\n", "same text", "same text"]


@pytest.mark.parametrize("max_words", [lexicon.MAX_WORDS, 20, 0])
def test_ids_and_text_are_those_of_the_library(spark, max_words):
    from tokenizers import Tokenizer
    rng = random.Random(5)
    alphabet = "abcde  ''\n\t.,!ÀñΩ東  🙂<|endoftext|>01"
    texts = TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(300)] + ["alpha beta gamma " * 9] * 4
    rows = [(i if i % 7 else None, i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, row int, text string, ids string").repartition(3)
    tok = Tokenizer.from_file(PATH)
    file = lexicon.fit_lexicon(docs, PATH, max_words=max_words)
    got = lexicon.decode_ids(lexicon.encode_texts(docs, PATH, file, key="row"), PATH).collect()
    assert len(got) == len(texts)
    for r in got:
        want = tok.encode(texts[r["key"]] or "", add_special_tokens=False).ids
        assert r["ids"] == want, texts[r["key"]]
        assert r["text"] == tok.decode(want, skip_special_tokens=False)
    assert sorted((k for k, *_ in lexicon.encode_texts(docs, PATH, file).collect()), key=repr) == sorted((r[0] for r in rows), key=repr)


def test_lexicon_holds_the_frequent_words(spark):
    docs = spark.createDataFrame([(1, "one two two three three three three"), (2, "four four four four four four four four once")], "doc_id long, text string")
    a = lexicon.Automaton.open(lexicon.fit_lexicon(docs, PATH, max_words=2))
    words = [b" four", b" three", b" two", b" once", b"four"]
    got = a.ordinals(np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)]))
    assert a.n_words == 2 and got.tolist() == [0, 1, -1, -1, -1]


def test_broken_bytes_decode_as_the_library_does(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(PATH)
    ids = [tok.encode("é東🙂", add_special_tokens=False).ids[i:j] for i in range(5) for j in range(i, 6)]
    got = lexicon.decode_ids(spark.createDataFrame(list(enumerate(ids)), "key long, ids array<int>"), PATH).collect()
    assert [r["text"] for r in sorted(got)] == [tok.decode(x, skip_special_tokens=False) for x in ids]


def test_token_bytes_cover_the_vocabulary():
    t = lexicon.token_bytes(PATH)
    assert len(t) == 50257 and t[50256].as_py() == b"<|endoftext|>" and {t[i].as_py() for i in range(256)} == {bytes([b]) for b in range(256)}
    assert isinstance(t, pa.LargeBinaryArray)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    ids = lexicon.encode_texts(docs, PATH, lexicon.fit_lexicon(docs, PATH))
    assert lexicon.decode_ids(ids, PATH).count() == 0


def test_encoder_and_decoder_never_share_a_task(spark):
    """Each Python process of a task holds a vocabulary; two in every running task outgrew an executor."""
    from adlift.llm import queries
    plan = queries.op11_lexicon_bpe(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
