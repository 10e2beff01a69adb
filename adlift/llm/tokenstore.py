"""Token-id shards with a minimal perfect hash index.

``write_tokens`` encodes every whole text and writes shards in ascending key
order; ``read_tokens`` reads them back by key.  A shard is two files:

* ``shard-<n>-<id>.bin``: raw little-endian ids, uint16 when the vocabulary
  allows it, else uint32; every text ends with the end id.
* ``shard-<n>-<id>.idx``: magic, id width, key count, the levels of a minimal
  perfect hash (bit arrays with rank samples), then in hash order a 32-bit
  fingerprint, the start position and the length, and last the keys in order.

A lookup hashes the key to its slot in constant time; the fingerprint rejects
keys that were never stored.  Task attempts write files of their own name and
report them; only reported files enter the manifest (a Parquet table beside the
shards), so a lost executor or a repeated attempt leaves no trace in the result.

Texts are split where no token can span (``piece_edges``).  Each distinct piece is
encoded once per worker, or per block beyond a bounded memory, by the tokenizers
library, which gives the ids of encoding the text whole.

Edge cases: with ``special_ids`` (the query's way) the literal text of an added token
gives its one id, as the library does by default, else the ids of its characters; a null or empty text is the end id alone; null keys sort first and
share slot "null"; of repeated keys each row keeps its own range (lookups return
the first); an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlift.llm.textops import mix64, utf8_chunks

END_ID = 2
SHARD_ROWS_BYTES = 32 << 20  # text bytes per shard, about
CACHE_PIECES = 300_000       # distinct pieces a worker remembers
JOINED_WORDS = 1000          # new words encoded in one call
BLOCK_BYTES = 8 << 20        # text bytes encoded at once; a longer text is one block
LAID_OUT = 1 << 18           # pieces whose ids are laid out at once
MAGIC = b"TOKIDX01"
GAMMA = 2.0                  # bits per key and level of the hash

_CODES = np.arange(128)
_LETTER, _PUNCT = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[[c for c in _CODES if chr(c).isalpha()]] = True
_PUNCT[[c for c in _CODES if 0x20 < c < 0x7F and not chr(c).isalnum()]] = True
_PUNCT_ALONE = _PUNCT.copy()
_PUNCT_ALONE[ord("'")] = False  # may begin a contraction


def piece_edges(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sorted byte positions where pieces of a block of texts begin, and its end.

    A piece ends where the tokenizer's pattern always ends a token: before a space that
    follows a non-space, between an ASCII letter and punctuation, before a line end that
    follows punctuation, and after it if a letter comes next."""
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[off] = True
    p, c = data[:-1], data[1:]
    space = (c == 0x20) & (p > 0x20)
    at = np.flatnonzero(space & (p >= 0x80))  # a longer character before the space: is it a space itself?
    b1, b2, b3 = data[at], data[at - 1], data[np.maximum(at - 2, 0)]
    blank = (b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0)) | (b3 == 0xE1) & ((b2 == 0x9A) | (b2 == 0xA0)) \
        | (b3 == 0xE2) & ((b2 == 0x80) | (b2 == 0x81)) | (b3 == 0xE3) & (b2 == 0x80)
    space[at[blank]] = False
    edge[1:-1] |= space | _LETTER[p] & _PUNCT_ALONE[c] | _PUNCT[p] & (c == 0x0A)
    edge[2:-1] |= _PUNCT[p[:-1]] & (p[1:] == 0x0A) & _LETTER[c[1:]]
    return np.flatnonzero(edge)


class PieceEncoder:
    """Blocks of texts to packed ids, one library call per distinct piece.

    With ``special_ids`` the tokenizer is left at its defaults: the literal text of an
    added token (``<|endoftext|>``) within a text gives that token's one id.  It is cut
    out first and is a piece of its own, so that no other edge falls into it.

    Arrow finds the distinct pieces of a block; numpy lays out their ids in text order.
    The pieces met first are remembered, later ones only within their block."""

    def __init__(self, path: str, dtype: str, special_ids: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not special_ids
        added = self.tok.get_added_tokens_decoder().values() if special_ids else []
        if odd := [t.content for t in added if t.lstrip or t.rstrip or t.single_word or not t.special]:
            raise ValueError(f"added tokens that are not plain literals: {odd}")
        texts = sorted((re.escape(t.content.encode()) for t in added), key=len, reverse=True)
        self._literal = re.compile(b"|".join(texts)) if texts else None
        self.dtype = dtype
        self.pieces: dict[str, bytes] = {}

    def _literals(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int]]:
        """Places of the added tokens' literal texts, none across two texts."""
        if self._literal is None:
            return []
        out, raw = [], data.tobytes()
        m = self._literal.search(raw)
        while m:
            a, b = m.span()
            end = int(off[np.searchsorted(off, a, side="right")])  # where a's text ends
            if b > end:  # runs into the next text: what lies within this one may still hold a shorter literal
                m = self._literal.match(raw, a, end) or self._literal.search(raw, a + 1)
                continue
            out.append((a, b))
            m = self._literal.search(raw, b)
        return out

    def encode(self, data: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, list[bytes]]:
        """Ids per text, the end id included, and the packed ids of all texts in order."""
        at = piece_edges(data, off) if len(data) else np.zeros(1, dtype=np.int64)
        if found := self._literals(data, off):  # each is a piece of its own
            a, b = np.array(found).T
            inside = np.searchsorted(a, at, side="right") - 1
            at = np.union1d(at[(inside < 0) | (at >= b[inside])], np.concatenate([a, b]))
        pieces = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        packed = [*self._ids(pieces.dictionary.to_pylist()), np.array([end_id], self.dtype).tobytes()]
        n = np.array([len(x) for x in packed], dtype=np.int64) // np.dtype(self.dtype).itemsize
        ids, first = np.frombuffer(b"".join(packed), self.dtype), np.cumsum(n) - n
        upto = np.searchsorted(at, off[1:])  # pieces of the texts so far
        order = np.insert(pieces.indices.to_numpy(), upto, len(packed) - 1)
        ends = np.cumsum(n[order])[upto + np.arange(len(upto))]
        out = []
        for i in range(0, len(order), LAID_OUT):
            o = order[i:i + LAID_OUT]
            size = n[o]
            skip = np.repeat(first[o] - (np.cumsum(size) - size), size)
            out.append(ids[skip + np.arange(len(skip))].tobytes())
        return np.diff(ends, prepend=0), out

    def _ids(self, pieces: list[str]) -> list[bytes]:
        known = self.pieces
        out = list(map(known.get, pieces))
        at = [i for i, x in enumerate(out) if x is None]
        new = [pieces[i] for i in at]
        fresh = self._encode_new(new)
        for i, x in zip(at, fresh, strict=True):
            out[i] = x
        if len(known) < CACHE_PIECES:
            known.update(zip(new, fresh, strict=True))
        return out

    def _encode_new(self, new: list[str]) -> list[bytes]:
        """Plain words (a space and letters: one token word each) go joined, many to a call."""
        out: list[bytes | None] = [None] * len(new)
        words = [i for i, x in enumerate(new) if x[0] == " " and x[1:].isalpha()]
        groups = [words[i:i + JOINED_WORDS] for i in range(0, len(words), JOINED_WORDS)]
        joined = ["".join([new[i] for i in g]) for g in groups]
        for g, e in zip(groups, self.tok.encode_batch(joined, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=self.dtype)
            at = np.flatnonzero(np.diff(np.array(e.word_ids), prepend=-1))
            if len(at) == len(g):
                raw = ids.tobytes()
                at = (at * ids.itemsize).tolist()
                for i, a, b in zip(g, at, [*at[1:], len(raw)], strict=True):
                    out[i] = raw[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        got = self.tok.encode_batch_fast([new[i] for i in rest], add_special_tokens=False)
        for i, e in zip(rest, got, strict=True):
            out[i] = np.array(e.ids, dtype=self.dtype).tobytes()
        return out


_ENCODERS: dict[tuple[str, str, bool], PieceEncoder] = {}


def _encoder(path: str, dtype: str, special_ids: bool = False) -> PieceEncoder:
    if (path, dtype, special_ids) not in _ENCODERS:
        _ENCODERS[path, dtype, special_ids] = PieceEncoder(path, dtype, special_ids)
    return _ENCODERS[path, dtype, special_ids]


# -- minimal perfect hash ---------------------------------------------------

def _level_hash(keys: np.ndarray, level: int) -> np.ndarray:
    return mix64(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


class PerfectHash:
    """Cascade of bit arrays: a key rests at the first level where it is alone at
    its bit; its slot is the number of set bits before that one."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels  # one bool array per level
        ones = [0, *np.cumsum([int(x.sum()) for x in levels])]
        self.ranks = [np.cumsum(x) - x + ones[i] for i, x in enumerate(levels)]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: distinct uint64."""
        levels, left, level = [], keys, 0
        while len(left):
            size = max(64, int(GAMMA * len(left)))
            at = (_level_hash(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
            level += 1
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of every key; -1 where no level holds it (never a stored key)."""
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = (_level_hash(keys[todo], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[todo[hit]] = self.ranks[level][at[hit]]
            todo = todo[~hit]
            if len(todo) == 0:
                break
        return out

    def to_bytes(self) -> bytes:
        parts = [struct.pack("<I", len(self.levels))]
        for x in self.levels:
            parts += [struct.pack("<Q", len(x)), np.packbits(x, bitorder="little").tobytes()]
        return b"".join(parts)

    @classmethod
    def from_buffer(cls, buf: bytes, pos: int) -> tuple[PerfectHash, int]:
        (n,) = struct.unpack_from("<I", buf, pos)
        pos += 4
        levels = []
        for _ in range(n):
            (size,) = struct.unpack_from("<Q", buf, pos)
            pos += 8
            nb = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(buf, np.uint8, nb, pos), bitorder="little")[:size].astype(bool))
            pos += nb
        return cls(levels), pos


NULL_KEY = np.uint64(0x6E756C6C6E756C6C)


def _key_hash(keys: np.ndarray, valid: np.ndarray) -> np.ndarray:
    h = mix64(keys.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
    return np.where(valid, h, NULL_KEY)


class ShardIndex:
    """Key -> (start, length) within one shard, in constant time per key."""

    def __init__(self, mph, prints, starts, lengths, keys, valid, width) -> None:
        self.mph, self.prints, self.starts, self.lengths = mph, prints, starts, lengths
        self.keys, self.valid, self.width = keys, valid, width

    @staticmethod
    def encode(keys: np.ndarray, valid: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> bytes:
        h, first = np.unique(_key_hash(keys, valid), return_index=True)
        mph = PerfectHash.build(h)
        slot = mph.slots(h)
        prints, st, ln = np.zeros(len(h), "<u4"), np.zeros(len(h), "<u8"), np.zeros(len(h), "<u8")
        prints[slot], st[slot], ln[slot] = (h >> np.uint64(32)).astype("<u4"), starts[first], lengths[first]
        return b"".join([MAGIC, struct.pack("<BQQ", width, len(h), len(keys)), mph.to_bytes(), prints.tobytes(),
                         st.tobytes(), ln.tobytes(), keys.astype("<i8").tobytes(), valid.astype("u1").tobytes(),
                         starts.astype("<u8").tobytes(), lengths.astype("<u8").tobytes()])

    @classmethod
    def decode(cls, buf: bytes) -> ShardIndex:
        if buf[:8] != MAGIC:
            raise ValueError("not a token index")
        width, n, rows = struct.unpack_from("<BQQ", buf, 8)
        mph, pos = PerfectHash.from_buffer(buf, 8 + 17)

        def take(dtype, count):
            nonlocal pos
            a = np.frombuffer(buf, dtype, count, pos)
            pos += a.nbytes
            return a
        prints, st, ln = take("<u4", n), take("<u8", n), take("<u8", n)
        keys, valid = take("<i8", rows), take("u1", rows).astype(bool)
        out = cls(mph, prints, st.astype(np.int64), ln.astype(np.int64), keys, valid, width)
        out.row_starts, out.row_lengths = take("<u8", rows).astype(np.int64), take("<u8", rows).astype(np.int64)
        return out

    def lookup(self, keys: np.ndarray, valid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the keys; start -1 for keys that are not stored."""
        valid = np.ones(len(keys), bool) if valid is None else valid
        h = _key_hash(np.asarray(keys, dtype=np.int64), valid)
        slot = self.mph.slots(h)
        ok = slot >= 0
        ok[ok] = self.prints[slot[ok]] == (h[ok] >> np.uint64(32)).astype(np.uint32)
        return (np.where(ok, self.starts[slot], -1) if len(self.starts) else np.full(len(h), -1),
                np.where(ok, self.lengths[slot], 0) if len(self.starts) else np.zeros(len(h), np.int64))


# -- Spark jobs -------------------------------------------------------------

MANIFEST = "shard int, bin string, idx string, rows long, tokens long, hi long"


def _write_shard(folder: str, tokenizer: str, dtype: str, end_id: int, special_ids: bool):
    def run(batches):
        from pyspark import TaskContext
        shard = TaskContext.get().partitionId()
        enc = _encoder(tokenizer, dtype, special_ids)
        fs, root = pafs.FileSystem.from_uri(folder)
        name = f"shard-{shard:05d}-{uuid.uuid4().hex}"
        width = np.dtype(dtype).itemsize
        keys, valid, lengths, out = [], [], [], None
        for b in batches:
            if b.num_rows == 0:
                continue
            out = out or fs.open_output_stream(f"{root}/{name}.bin", compression=None)
            k = b.column(0)
            keys.append(k.fill_null(0).to_numpy(zero_copy_only=False))
            valid.append(k.is_valid().to_numpy(zero_copy_only=False))
            for _, _, data, off in utf8_chunks(b.column(1), BLOCK_BYTES):
                n, packed = enc.encode(data, off, end_id)
                lengths.append(n)
                for x in packed:
                    out.write(x)
        if out is None:
            return
        out.close()
        n = np.concatenate(lengths)
        starts = np.concatenate(([0], np.cumsum(n)[:-1]))
        with fs.open_output_stream(f"{root}/{name}.idx", compression=None) as f:
            f.write(ShardIndex.encode(np.concatenate(keys), np.concatenate(valid), starts, n, width))
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([shard], pa.int32()), "bin": [f"{name}.bin"], "idx": [f"{name}.idx"],
            "rows": pa.array([len(n)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64()),
            "hi": pa.array([int(k[-1]) if (k := np.concatenate(keys)[np.concatenate(valid)]).size else None], pa.int64())})
    return run


def _uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, key: str = "doc_id",
                 text: str = "text", vocab_size: int = 50257, special_ids: bool = False) -> None:
    """Encode every text and write shards plus ``manifest`` under ``folder`` (shared)."""
    spark = docs.sparkSession
    dtype = "<u2" if max(vocab_size - 1, end_id) < 1 << 16 else "<u4"
    src = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, int(size // SHARD_ROWS_BYTES))
    uri = _uri(folder)
    fs, root = pafs.FileSystem.from_uri(uri)
    fs.create_dir(root, recursive=True)
    dealt = src.repartitionByRange(shards, F.col("key").asc_nulls_first()).sortWithinPartitions(
        F.col("key").asc_nulls_first())
    dealt.mapInArrow(_write_shard(uri, tokenizer, dtype, end_id, special_ids), MANIFEST).write.parquet(f"{uri}/manifest")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Shards in order, each with the ids before it."""
    rows = spark.read.parquet(f"{_uri(folder)}/manifest").orderBy("shard").collect()  # one row per shard
    base, out = 0, []
    for r in rows:
        out.append((*r, base))
        base += r["tokens"]
    return spark.createDataFrame(out, MANIFEST + ", base long")


RANGES = "key long, start long, n_tokens long, ids binary"


def _read_shard(folder: str, with_ids: bool):
    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for r in b.to_pylist():
                with fs.open_input_file(f"{root}/{r['idx']}") as f:
                    index = ShardIndex.decode(f.readall())
                starts, lengths = index.lookup(index.keys, index.valid)
                h = _key_hash(index.keys, index.valid)
                if len(np.unique(h)) < len(h):  # repeated keys: each row has its own range
                    starts, lengths = index.row_starts, index.row_lengths
                with fs.open_input_file(f"{root}/{r['bin']}") as f:
                    i = 0
                    while i < len(starts):
                        upto = np.cumsum(lengths[i:])
                        j = i + max(1, int(np.searchsorted(upto, 4 << 20)))
                        f.seek(int(starts[i]) * index.width)
                        raw = np.frombuffer(f.read(int(lengths[i:j].sum()) * index.width), f"<u{index.width}")
                        cut = (starts[i:j] - starts[i])
                        ids = [raw[a:a + n].astype("<u4") for a, n in zip(cut, lengths[i:j], strict=True)]
                        keys = pa.array(index.keys[i:j], mask=~index.valid[i:j])
                        cols = [keys, pa.array(starts[i:j] + r["base"]), pa.array(lengths[i:j])]
                        last = (pa.array([x.tobytes() for x in ids], pa.binary()) if with_ids
                                else pa.array([zlib.crc32(x) for x in ids], pa.int64()))
                        yield pa.RecordBatch.from_arrays([*cols, last], ["key", "start", "n_tokens", "ids" if with_ids else "crc"])
                        i = j
    return run


def read_tokens(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """``key, start, n_tokens`` and the ids as little-endian uint32 bytes; with
    ``digest`` their crc32 instead, computed where the shard is read."""
    m = manifest(spark, folder)
    n = max(1, m.count())
    m = m.repartition(n, "shard")
    schema = RANGES if not digest else RANGES.replace("ids binary", "crc long")
    return m.mapInArrow(_read_shard(_uri(folder), not digest), schema)


def _assign_shards(bounds: np.ndarray):
    """First shard whose largest key is not below the wanted one."""
    def run(batches):
        for b in batches:
            k = b.column("key").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(np.searchsorted(bounds, k).astype(np.int32))], ["key", "at"])
    return run


def _fetch(folder: str, shards: list[dict]):
    def run(t: pa.Table) -> pa.Table:
        fs, root = pafs.FileSystem.from_uri(folder)
        out: list[tuple] = []
        at = t.column("at")[0].as_py() if t.num_rows else len(shards)
        if at < len(shards):
            r = shards[at]
            with fs.open_input_file(f"{root}/{r['idx']}") as f:
                index = ShardIndex.decode(f.readall())
            keys = t.column("key").to_numpy()
            starts, lengths = index.lookup(keys)
            with fs.open_input_file(f"{root}/{r['bin']}") as f:
                for k, s, n in zip(keys.tolist(), starts.tolist(), lengths.tolist(), strict=True):
                    if s >= 0:
                        f.seek(s * index.width)
                        ids = np.frombuffer(f.read(n * index.width), f"<u{index.width}").astype("<u4")
                        out.append((k, s + r["base"], n, ids.tobytes()))
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], ["key", "start", "n_tokens", "ids"])
    return run


def lookup(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """Ranges and ids of the wanted keys (column ``key``).  A key is sent to the shard
    whose key range holds it; there the index gives its place and only its bytes are
    read.  Keys that are not stored give no row."""
    shards = [r.asDict() for r in manifest(spark, folder).where("hi is not null").orderBy("shard").collect()]  # one row per shard
    bounds = np.array([r["hi"] for r in shards], dtype=np.int64)
    wanted = keys.select(F.col("key").cast("long").alias("key")).where("key is not null").distinct()
    wanted = wanted.mapInArrow(_assign_shards(bounds), "key long, at int")
    return wanted.groupBy("at").applyInArrow(_fetch(_uri(folder), shards), RANGES)
