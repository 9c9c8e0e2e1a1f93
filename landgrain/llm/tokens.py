"""Token ids in files: frequency-ranked, byte-aligned variable-length coding.

A file row is a block of consecutive documents in ascending doc_id order. Its payload holds, little-endian:
the number of documents, of ids and of distinct ids (3 x 8 bytes); the documents' ids (8 bytes each, after a byte
that tells nulls), the documents' lengths in ids (4 bytes each); the distinct ids by falling frequency in
the block (4 bytes each), the smaller id first among equals; the control bytes; the data bytes. An id is written as its rank, in 1 to 4 data
bytes; its control bits (two, four ids to a byte, the first in the lowest bits) hold that number less one.
Decoding looks a control byte's four lengths up in a table of 256 and gathers the bytes with numpy.

Blocks are rows of Parquet files, so writing and reading go through Spark on any file system, and a lost
task never leaves half a file behind.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, slices, table

END = 2
BLOCK_IDS = 1 << 20
#: Pre-tokens whose ids an encoder remembers; beyond, it keeps those of the texts at hand
CACHE = 1_000_000
#: Text bytes that are encoded together
TOGETHER = 3 << 20

_LENGTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3) + 1

#: Printable stand-ins of bytes in the byte-level tokenizer's vocabulary
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_STAND_IN = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(_PRINTABLE))}
_SPACE = chr(_STAND_IN[0x20])
#: Scripts up to here are cut into pre-tokens by this module, others by the library
_LATIN = "\u024f"
_BEYOND = r"[^\x{00}-\x{24f}]"
#: White space that is not one space or one line end between two words; the separator
_UNUSUAL = r"\A[ \n]|[ \n]\z|[ \n][ \n]|[\x{00}\t\v\f\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Pre-tokens of a word that are not letters (a fixed pattern of the tokenizer); letters are what stands between
_CUTS = r"('s|'t|'re|'ve|'m|'ll|'d| ?\pN+| ?[^\s\pL\pN]+|\n)"


def _offsets(a: pa.Array) -> np.ndarray:
    """Where the values of a list or binary array begin and end."""
    return np.frombuffer(a.buffers()[1], np.int32, len(a) + 1, 4 * a.offset)


def _data(a: pa.Array) -> memoryview:
    """The bytes of all values of a binary array, one after the other."""
    at = _offsets(a)
    return memoryview(a.buffers()[2] or b"")[at[0] : at[-1]]


class Encoder:
    """Encodes texts with the tokenizers library, remembering the ids of pre-tokens.

    A word takes the space or line end before it with it. The tokenizer's pre-tokens never cross from other characters to
    white space, and what it makes of the rest of a text does not depend on what stands before, so a text's ids
    are its words' ids in turn, and a word's those of its pre-tokens. Arrow numbers the different words of many texts and
    their pre-tokens; the library's model encodes new ones. Texts with other white space, or with a special
    token's string, are encoded whole, as are all texts of a tokenizer of another kind.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        pre = self.tokenizer.pre_tokenizer
        self.chunked = self.tokenizer.normalizer is None and isinstance(pre, ByteLevel) and not pre.add_prefix_space
        self.known: dict[str, bytes] = {"": b""}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of pre-tokens, and of words beyond _LATIN."""
        try:
            return list(map(self.known.__getitem__, pieces))
        except KeyError:
            known = self.known
        new = [x for x in pieces if x not in known]
        if len(known) + len(new) > CACHE:
            known = self.known = {x: known[x] for x in pieces if x in known} | {"": b""}
        model = self.tokenizer.model.tokenize
        for x in new:
            if x.isascii() and x.isprintable():
                symbols = x.replace(" ", _SPACE)
            elif max(x) <= _LATIN:
                symbols = x.encode().decode("latin-1").translate(_STAND_IN)
            else:
                known[x] = self._whole(x)
                continue
            known[x] = array("I", [t.id for t in model(symbols)]).tobytes()
        return list(map(known.__getitem__, pieces))

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without unusual white space, one after the other, and how many each has."""
        marked = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n")
        words = pc.split_pattern(marked, "\0")
        numbered = words.flatten().dictionary_encode()
        own = numbered.dictionary
        cut = pc.split_pattern(pc.if_else(pc.match_substring_regex(own, _BEYOND), own, pc.replace_substring_regex(own, _CUTS, "\0\\1\0")), "\0")
        pieces = cut.flatten().dictionary_encode()
        # one string, cut by Python, is cheaper than a string for each value
        names = pc.binary_join(pa.ListArray.from_arrays([0, len(pieces.dictionary)], pieces.dictionary), "\0")[0].as_py().split("\0")
        ids = pa.array(self._pieces(names), pa.binary()).take(pieces.indices)
        of_words = pa.BinaryArray.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(_offsets(ids)[_offsets(cut)]), ids.buffers()[2]])
        of_texts = of_words.take(numbered.indices)
        ends = _offsets(of_texts)[_offsets(words) - _offsets(words)[0]].astype(np.int64) // 4
        return np.frombuffer(_data(of_texts), "<u4"), np.diff(ends)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has; null is empty."""
        texts = pc.fill_null(texts, "")
        if self.chunked:
            odd = pc.match_substring_regex(texts, _UNUSUAL)
            for s in self.special:
                odd = pc.or_(odd, pc.match_substring(texts, s))
        else:
            odd = pa.array([True] * len(texts), pa.bool_())
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if not len(whole):
            return self._plain(texts)
        flat, count = self._plain(texts.filter(pc.invert(odd)))
        counts = np.zeros(len(texts), np.int64)
        plain = np.setdiff1d(np.arange(len(texts)), whole)
        counts[plain] = count
        parts: list = [None] * len(texts)
        for i, part in zip(plain.tolist(), np.split(flat, np.cumsum(count)[:-1]), strict=False):
            parts[i] = part
        for i, text in zip(whole.tolist(), texts.take(pa.array(whole)).to_pylist(), strict=True):
            parts[i] = np.frombuffer(self._whole(text), "<u4")
            counts[i] = len(parts[i])
        return np.concatenate(parts), counts


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The payload of a block: its documents, how many ids each has, and all of them."""
    if ids.max(initial=0) < 1 << 24:
        counts = np.bincount(ids, minlength=1)
        distinct = np.flatnonzero(counts)
        counts, place = counts[distinct], np.cumsum(counts > 0)[ids] - 1
    else:  # no table of all smaller ids
        distinct, place, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((distinct, -counts))
    rank = np.zeros(len(distinct), "<u4")
    rank[order] = np.arange(len(order))
    r = rank[place]
    size = (r > 0xFF).astype(np.uint8)
    for bound in (0xFFFF, 0xFFFFFF):
        size += r > bound
    control = np.zeros(-len(r) % 4 + len(r), np.uint8)
    control[: len(r)] = size
    control = control.reshape(-1, 4)
    control = control[:, 0] | control[:, 1] << 2 | control[:, 2] << 4 | control[:, 3] << 6
    data = r.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= size[:, None]]
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    own = np.array([d or 0 for d in doc_ids], "<i8")
    head = np.array([len(doc_ids), len(r), len(distinct)], "<i8")
    return b"".join(x.tobytes() for x in (head, nulls, own, lengths.astype("<u4"), distinct[order].astype("<u4"), control, data))


def unpack(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and all ids of a block."""
    n, m, k = np.frombuffer(payload, "<i8", 3).tolist()
    at = 24
    nulls = np.frombuffer(payload, np.uint8, n, at)
    own = np.frombuffer(payload, "<i8", n, at := at + n)
    lengths = np.frombuffer(payload, "<u4", n, at := at + 8 * n)
    ranked = np.frombuffer(payload, "<u4", k, at := at + 4 * n)
    control = np.frombuffer(payload, np.uint8, (m + 3) // 4, at := at + 4 * k)
    size = _LENGTHS[control].reshape(-1)[:m]
    data = np.concatenate([np.frombuffer(payload, np.uint8, offset=at + len(control)), np.zeros(4, np.uint8)])
    start = np.cumsum(size) - size
    rank = data[start].astype(np.int64)
    for b in range(1, int(size.max(initial=1))):
        rank |= np.where(size > b, data[start + b].astype(np.int64) << 8 * b, 0)
    return [None if z else d for z, d in zip(nulls.tolist(), own.tolist(), strict=True)], lengths, ranked[rank]


def _write(path: str | None, end: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path is None:
            import public_tokenizers

            encoder = _encoder(public_tokenizers.path("byte_bpe_50k.json"))
        else:
            encoder = _encoder(path)
        part, before, held, docs, counts, ids = TaskContext.get().partitionId(), 0, 0, [], [], []

        def close() -> pa.RecordBatch:
            payload = pack(docs, np.concatenate(counts), np.concatenate(ids))
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([payload], pa.binary())], names=["part", "before", "n_ids", "payload"])

        for b in slices(batches, "text", TOGETHER, 1 << 14):
            flat, count = encoder.encode(b.column("text"))
            flat = np.insert(flat, np.cumsum(count), end)
            count += 1
            own, ends = b.column("doc_id").to_pylist(), np.cumsum(count)
            at = 0
            while at < len(own):  # a block ends with the document that fills it
                taken = int(ends[at - 1]) if at else 0
                to = min(len(own), int(np.searchsorted(ends, taken + block - held)) + 1)
                docs += own[at:to]
                counts.append(count[at:to])
                ids.append(flat[taken : ends[to - 1]])
                held += int(ends[to - 1]) - taken
                at = to
                if held >= block:
                    yield close()
                    before, held, docs, counts, ids = before + held, 0, [], [], []
            pa.default_memory_pool().release_unused()  # a worker lives as long as its executor
        if docs:
            yield close()

    return run


def write_tokens(docs: DataFrame, path: str | None = None, end: int = END, block: int = BLOCK_IDS) -> DataFrame:
    """Encode every text of docs and write the blocks; the table read back: part, before, n_ids, payload.

    Texts are encoded whole, whatever their length; one that fills a block has it for itself. An empty table gives no blocks.

    path: the tokenizer's file, on every executor; None is the public byte-level one. Null texts are empty;
    rows without a doc_id come first; rows that repeat a doc_id stand side by side, in the order of their texts' hashes.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return materialise(ordered.mapInArrow(_write(path, end, block), "part int, before long, n_ids long, payload binary"), "tokens", "none")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, before, payload in zip(b.column("part").to_pylist(), b.column("before").to_pylist(), b.column("payload").to_pylist(), strict=True):
            docs, lengths, ids = unpack(payload)
            raw = memoryview(ids.astype("<u4").tobytes())
            ends = np.cumsum(lengths.astype(np.int64))
            starts = ends - lengths
            crcs = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.record_batch([pa.array([part] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(starts + before), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())], names=["part", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_tokens(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the written blocks."""
    # one row for a part of the files, so as few as the writer had tasks
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    first = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    rows = blocks.mapInArrow(_read, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(first), "part").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents")))
