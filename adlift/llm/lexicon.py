"""Byte-pair encoding through a minimal acyclic transducer of frequent words.

``fit_lexicon`` counts the pieces of all texts, takes the frequent ones and compiles
them, with the ids the tokenizer gives them, into one automaton file in the shared
folder.  ``encode_texts`` maps that file into memory, looks the distinct pieces of a
block of texts up in it, all at once, and merges the pieces it does not hold with the
tokenizers library, so the ids are those of the library whatever the lexicon holds.
``decode_ids`` joins the byte strings of the ids.

Automaton: built from the sorted words, equal suffixes shared as soon as they are
complete (incremental minimisation), so it is the smallest one for its words.  An arc
carries the number of words that precede those behind it; the sum along a word's path
is the word's ordinal, which addresses its ids.  Arcs are sorted by (state, byte): a
step of many words is one binary search.

File: magic, 5 counts, then arrays: arc keys (state * 256 + byte), arc targets, arc
outputs, final states, id offsets per word, ids.

Scale: pieces are counted per task before the shuffle; the cut between frequent and
other words comes from a histogram of at most 512 counts; the lexicon has at most
``MAX_WORDS`` words of at most ``MAX_WORD_BYTES`` bytes, so it is compiled in one task
and its size does not depend on the table.

Edge cases: a null text is empty and has no ids; the literal text of an added token
gives its one id, as the library does; repeated rows and null keys give one row each;
an empty table gives an empty lexicon and no rows; other columns are ignored.
"""

from __future__ import annotations

import mmap
import os
import re
import struct
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlift.llm.store import scratch, written
from adlift.llm.textops import utf8_chunks
from adlift.llm.tokenstore import _uri, piece_edges

MAX_WORDS = 1 << 16
MAX_WORD_BYTES = 64
MIN_COUNT = 2
BLOCK_BYTES = 1 << 20    # text bytes handled at once; a longer text is one block
COUNTED = 400_000        # distinct pieces a task holds before it passes their counts on
MERGED = 200_000         # pieces outside the lexicon whose ids a worker remembers
BATCH = 4096             # pieces the library merges at once
STEPS_AN_OCTAVE = 8      # histogram of counts
MAGIC = b"ACYCLEX1"


# -- automaton --------------------------------------------------------------

def compile_automaton(words: list[bytes], ids: list[list[int]]) -> bytes:
    """File bytes of the minimal automaton of ``words`` (distinct, ascending, not empty)."""
    final, arcs = [False], [[]]  # arcs: per state (byte, target) in ascending order
    register: dict[tuple, int] = {}

    def close(path: list[int], depth: int) -> None:
        """Replace the states of ``path`` below ``depth`` by equal ones met before."""
        while len(path) > depth + 1:
            state = path.pop()
            same = register.setdefault((final[state], tuple(arcs[state])), state)
            if same != state:
                label, _ = arcs[path[-1]][-1]
                arcs[path[-1]][-1] = (label, same)

    path, before = [0], b""
    for w in words:
        shared = len(os.path.commonprefix([before, w]))
        close(path, shared)
        for b in w[shared:]:
            final.append(False)
            arcs.append([])
            arcs[path[-1]].append((b, len(arcs) - 1))
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        before = w
    close(path, 0)

    number, order = {0: 0}, [0]  # states still in use, renumbered
    for s in order:
        for _, t in arcs[s]:
            if t not in number:
                number[t] = len(order)
                order.append(t)
    behind: dict[int, int] = {}  # words accepted from a state
    todo = [0]
    while todo:
        open_ = [t for _, t in arcs[todo[-1]] if t not in behind]
        if open_:
            todo.extend(open_)
            continue
        s = todo.pop()
        behind[s] = int(final[s]) + sum(behind[t] for _, t in arcs[s])
    keys, targets, outputs = [], [], []
    for s in order:
        passed = int(final[s])
        for b, t in arcs[s]:
            keys.append(number[s] * 256 + b)
            targets.append(number[t])
            outputs.append(passed)
            passed += behind[t]
    flat = [i for x in ids for i in x]
    off = np.cumsum([0, *map(len, ids)])
    parts = [np.array(keys, "<i8"), np.array(targets, "<i4"), np.array(outputs, "<i4"),
             np.array([final[s] for s in order], "u1"), off.astype("<i4"), np.array(flat, "<i4")]
    head = MAGIC + struct.pack("<4q", len(keys), len(order), len(words), len(flat))
    return head + b"".join(x.tobytes() + b"\0" * (-x.nbytes % 8) for x in parts)


class Automaton:
    """Words to ids over a mapped automaton file."""

    def __init__(self, buf) -> None:
        if bytes(buf[:8]) != MAGIC:
            raise ValueError("not an automaton file")
        n_arcs, n_states, n_words, n_ids = struct.unpack_from("<4q", buf, 8)
        at, self.n_states, self.n_words, out = 40, n_states, n_words, []
        for dtype, n in (("<i8", n_arcs), ("<i4", n_arcs), ("<i4", n_arcs), ("u1", n_states), ("<i4", n_words + 1), ("<i4", n_ids)):
            out.append(np.frombuffer(buf, dtype, n, at))
            at += -(-out[-1].nbytes // 8) * 8
        self.keys, self.targets, self.outputs, self.final, self.off, self.ids = out

    @classmethod
    def open(cls, uri: str) -> Automaton:
        """Mapped from the shared folder; from a store that cannot be mapped, by an
        unnamed file of this process."""
        fs, path = pafs.FileSystem.from_uri(uri)
        if isinstance(fs, pafs.LocalFileSystem):
            with open(path, "rb") as f:
                return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        with fs.open_input_stream(path) as src, tempfile.TemporaryFile() as f:
            while part := src.read(1 << 20):
                f.write(part)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def ordinals(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Ordinal of each byte string ``data[off[i]:off[i + 1]]``; -1 if it is none of the words."""
        size = np.diff(off)
        out = np.full(len(size), -1, dtype=np.int64)
        if not len(self.keys):
            return out
        todo = np.flatnonzero((size > 0) & (size <= MAX_WORD_BYTES))
        state, total = np.zeros(len(todo), np.int64), np.zeros(len(todo), np.int64)
        step = 0
        while len(todo):
            want = state * 256 + data[off[todo] + step]
            arc = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            ok = self.keys[arc] == want
            todo, arc = todo[ok], arc[ok]
            state, total = self.targets[arc].astype(np.int64), total[ok] + self.outputs[arc]
            step += 1
            ends = size[todo] == step
            hit = ends & (self.final[state] == 1)
            out[todo[hit]] = total[hit]
            todo, state, total = todo[~ends], state[~ends], total[~ends]
        return out


# -- pieces of texts --------------------------------------------------------

def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def added_literals(tok) -> re.Pattern | None:
    """The literal texts of the added tokens, longest first."""
    added = list(tok.get_added_tokens_decoder().values())
    if odd := [t.content for t in added if t.lstrip or t.rstrip or t.single_word or t.normalized]:
        raise ValueError(f"added tokens that are not plain literals: {odd}")
    texts = sorted((re.escape(t.content.encode()) for t in added), key=len, reverse=True)
    return re.compile(b"|".join(texts)) if texts else None


def text_pieces(data: np.ndarray, off: np.ndarray, literals: re.Pattern | None = None) -> np.ndarray:
    """Byte positions where the pieces of a block of texts begin, and its end.  A literal
    is a piece of its own and ends the text before it, as a text's end does."""
    if not len(data):
        return np.zeros(1, np.int64)
    spans = []
    if literals is not None and (raw := data.tobytes()) and literals.search(raw):
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            spans += [m.span() for m in literals.finditer(raw, a, b)]
    if not spans:
        return piece_edges(data, off)
    a, b = np.array(spans).T
    at = piece_edges(data, np.union1d(off, np.concatenate([a, b])))
    inside = np.searchsorted(a, at, side="right") - 1
    return np.union1d(at[(inside < 0) | (at >= b[inside])], np.concatenate([a, b]))


def _distinct(data: np.ndarray, at: np.ndarray):
    pieces = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))
    return pieces.dictionary_encode()


def _frugal() -> None:
    """Arrow memory of this worker from the C library: other pools keep what blocks no longer use."""
    pa.set_memory_pool(pa.system_memory_pool())


def _count_pieces(tokenizer: str):
    def run(batches):
        _frugal()
        literals = added_literals(_tokenizer(tokenizer))
        held, rows = [], 0

        def merged():
            t = pa.concat_tables(held).group_by("piece").aggregate([("n", "sum")])
            return pa.table({"piece": t["piece"], "n": t["n_sum"]})

        for b in batches:
            for _, _, data, off in utf8_chunks(b.column(0), BLOCK_BYTES):
                at = text_pieces(data, off, literals)
                d = _distinct(data, at)
                n = np.bincount(d.indices.to_numpy(), minlength=len(d.dictionary))
                short = pc.less_equal(pc.binary_length(d.dictionary), MAX_WORD_BYTES)
                t = pa.table({"piece": d.dictionary, "n": pa.array(n, pa.int64())}).filter(short)
                held.append(t)
                rows += t.num_rows
            if rows > COUNTED:
                t = merged()
                held, rows = [t], t.num_rows
                if rows > COUNTED // 2:
                    yield from t.combine_chunks().to_batches()
                    held, rows = [], 0
        if held:
            yield from merged().combine_chunks().to_batches()
    return run


def _compile(tokenizer: str, folder: str):
    def run(batches):
        words: list[str] = []
        for b in batches:
            words += b.column(0).to_pylist()
        raw = [w.encode() for w in words]
        tok = _tokenizer(tokenizer)
        ids = [e.ids for i in range(0, len(words), BATCH)
               for e in tok.encode_batch_fast(words[i:i + BATCH], add_special_tokens=False)]
        yield pa.RecordBatch.from_pydict({"name": [_write(folder, compile_automaton(raw, ids))]})
    return run


def _write(folder: str, automaton: bytes) -> str:
    """Write an automaton file, under a name of its own so that attempts never meet."""
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
        f.write(automaton)
    return name


def fit_lexicon(docs: DataFrame, tokenizer: str, text: str = "text", max_words: int = MAX_WORDS) -> str:
    """Compile the frequent pieces of all texts; returns the automaton file's URI.

    Pieces counted at least ``MIN_COUNT`` times are taken in steps of the histogram of
    their counts, from the highest, as long as they are at most ``max_words``."""
    spark = docs.sparkSession
    src = docs.select(F.col(text).cast("string").alias("text"))
    counts = src.mapInArrow(_count_pieces(tokenizer), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    step = F.floor(F.log2("n") * STEPS_AN_OCTAVE).cast("int")
    counts = written(counts.where(F.col("n") >= MIN_COUNT).withColumn("step", step), "piece-counts")
    taken, cut = 0, None
    for r in sorted(counts.groupBy("step").count().collect(), reverse=True):  # at most 64 * STEPS_AN_OCTAVE rows
        taken += r["count"]
        if taken > max_words:
            break
        cut = r["step"]
    words = counts.where(F.col("step") >= F.lit(cut)).select("piece")
    folder = _uri(scratch(spark, "lexicon"))
    done = words.repartition(1).sortWithinPartitions("piece").mapInArrow(_compile(tokenizer, folder), "name string").first()
    return f"{folder}/{done['name'] if done else _write(folder, compile_automaton([], []))}"


# -- encoding ---------------------------------------------------------------

class LexiconEncoder:
    """Blocks of texts to ids: the lexicon's automaton, exact merges for the rest."""

    def __init__(self, tokenizer: str, lexicon: str) -> None:
        self.tok, self.automaton = _tokenizer(tokenizer), Automaton.open(lexicon)
        self.literals = added_literals(self.tok)
        self.merged: dict[str, np.ndarray] = {}

    def _merge(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of pieces outside the lexicon."""
        out = list(map(self.merged.get, pieces))
        at = [i for i, x in enumerate(out) if x is None]
        new = [pieces[i] for i in at]
        for j in range(0, len(new), BATCH):  # the library's result takes about a kilobyte a piece
            for i, e in zip(at[j:j + BATCH], self.tok.encode_batch_fast(new[j:j + BATCH], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, np.int32)
        if len(self.merged) + len(new) <= MERGED:
            self.merged.update((p, out[i]) for p, i in zip(new, at, strict=True) if len(p) <= MAX_WORD_BYTES)
        return out

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block's texts in order and their offsets per text."""
        at = text_pieces(data, off, self.literals)
        pieces = _distinct(data, at)
        words, index = pieces.dictionary, pieces.indices.to_numpy()
        _, bounds, raw = words.buffers()
        bounds = np.frombuffer(bounds, np.int32, len(words) + 1).astype(np.int64)
        raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        a = self.automaton
        rank = a.ordinals(raw, bounds)
        rest = np.flatnonzero(rank < 0)
        merged = self._merge(words.take(pa.array(rest)).to_pylist())
        first, size = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        hit = rank >= 0
        first[hit], size[hit] = a.off[rank[hit]], a.off[rank[hit] + 1] - a.off[rank[hit]]
        size[rest] = [len(x) for x in merged]
        first[rest] = len(a.ids) + np.cumsum(size[rest]) - size[rest]
        pool = np.concatenate([a.ids, *merged])
        n = size[index]
        upto = np.concatenate(([0], np.cumsum(n)))
        ids = pool[np.repeat(first[index] - upto[:-1], n) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(at, off)]


_ENCODERS: dict[tuple[str, str], LexiconEncoder] = {}


def _encode(tokenizer: str, lexicon: str):
    def run(batches):
        _frugal()
        if (tokenizer, lexicon) not in _ENCODERS:
            _ENCODERS.clear()  # one lexicon at a time in a reused worker
            _ENCODERS[tokenizer, lexicon] = LexiconEncoder(tokenizer, lexicon)
        enc = _ENCODERS[tokenizer, lexicon]
        for b in batches:
            for i, j, data, off in utf8_chunks(b.column(1), BLOCK_BYTES):
                ids, bounds = enc.encode(data, off)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), lists], ["key", "ids"])
    return run


def encode_texts(docs: DataFrame, tokenizer: str, lexicon: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids)`` of every row of ``docs``."""
    src = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(_encode(tokenizer, lexicon), "key long, ids array<int>")


# -- decoding ---------------------------------------------------------------

def byte_of_char() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones of
    Latin-1 for themselves, those from U+0100 on for the other bytes in order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(tokenizer: str) -> pa.LargeBinaryArray:
    """Byte string of every id."""
    tok, char = _tokenizer(tokenizer), byte_of_char()
    out: list[bytes] = [b""] * tok.get_vocab_size(with_added_tokens=True)
    added = tok.get_added_tokens_decoder()
    for t, i in tok.get_vocab(with_added_tokens=True).items():
        out[i] = t.encode() if i in added else bytes(char[c] for c in t)
    return pa.array(out, pa.large_binary())


def _decode(tokens: bytes):
    def run(batches):
        _frugal()
        table = pa.ipc.open_stream(tokens).read_next_batch().column(0)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                lists = part.column(1)
                flat = table.take(lists.flatten())
                _, bounds, raw = flat.buffers()
                bounds = np.frombuffer(bounds, np.int64, len(flat) + 1, flat.offset * 8)
                upto = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())))
                raw, ends = memoryview(raw if raw is not None else b""), bounds[upto].tolist()
                texts = [bytes(raw[x:y]).decode("utf-8", "replace") for x, y in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(texts, pa.string())], ["key", "ids", "text"])
    return run


def decode_ids(ids: DataFrame, tokenizer: str) -> DataFrame:
    """``(key, ids, text)`` of ``(key, ids)`` rows; bytes that are no UTF-8 become U+FFFD."""
    sink, tokens = pa.BufferOutputStream(), pa.record_batch([token_bytes(tokenizer)], ["token"])
    with pa.ipc.new_stream(sink, tokens.schema) as out:  # under a megabyte; workers need no tokenizer
        out.write_batch(tokens)
    return ids.select("key", "ids").mapInArrow(_decode(sink.getvalue().to_pybytes()), "key long, ids array<int>, text string")
