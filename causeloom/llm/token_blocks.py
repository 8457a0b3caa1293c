"""Token ids in patched frame-of-reference blocks.

Format.  The ids of a run of whole documents form a *segment* (one row of the
staged table, about ``SEGMENT`` ids).  A segment is cut into blocks of 128 ids.
For each block the minimum is subtracted and the rest is packed in the number of
bits that holds the value at a chosen percentile; the high bits of the few larger
values go to an exception list.  A segment's bytes, all little-endian::

    u32 n_ids, u32 n_exceptions
    u32 minimum of each block
    u8  width of each block
    u8  exceptions of each block (up to 128)
    u32 start of each block in the packed area          <- the index
    packed area, 16 * width bytes for each block
    u8  place of each exception in its block
    u32 high bits of each exception

So one block is found and unpacked without touching the others
(:func:`read_block`).

Distribution.  Rows are dealt by ranges of the id column and sorted within the
range; a task encodes its range in order and numbers it from 0.  The offsets of
the ranges come from one small table with a row for each task.  Files are written
and read by Spark, in the shared folder; a lost executor only repeats its tasks.

Defined results: a null text is empty and holds the end id alone; null ids come
first; rows of one id follow each other in an order of their texts' hashes; repeated rows are encoded each; an empty table gives no rows.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .caching import Memo
from .staging import stage
from .units import cuts, spread

BLOCK = 128
#: Ids of a segment at which it is closed.
SEGMENT = 1 << 18
#: Share of a block's values that must fit the packed width.
PERCENTILE = 0.9
#: Appended to every document.
END_ID = 1
#: Bytes that one worker's memo of words takes at most.
MEMO = 96 << 20
_SPEC = "part int, first long, n_ids long, doc_ids array<{kind}>, lengths array<long>, segment binary"


def _widths(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """A segment of the ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    values = np.empty(blocks * BLOCK, np.uint64)
    values[:n] = ids
    if blocks:
        values[n:] = values[n - 1]  # padding that widens nothing
    values = values.reshape(blocks, BLOCK)
    low = values.min(axis=1, initial=1 << 32) if blocks else np.empty(0, np.uint64)
    values = values - low[:, None]
    at = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    width = _widths(np.partition(values, at, axis=1)[:, at]) if blocks else np.empty(0, np.int64)
    high = values >> width.astype(np.uint64)[:, None]
    block_of, place = np.nonzero(high)
    counts = np.bincount(block_of, minlength=blocks)
    starts = np.concatenate([[0], np.cumsum(width * (BLOCK // 8))])
    area = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width):
        w = int(w)
        if w == 0:
            continue
        chosen = np.nonzero(width == w)[0]
        lanes = np.ascontiguousarray((values[chosen] & np.uint64((1 << w) - 1)).T)
        words = np.zeros((2 * w, len(chosen)), np.uint64)
        for lane in range(BLOCK):
            word, shift = divmod(lane * w, 64)
            words[word] |= lanes[lane] << np.uint64(shift)
            if shift + w > 64:
                words[word + 1] |= lanes[lane] >> np.uint64(64 - shift)
        packed = np.ascontiguousarray(words.T).astype("<u8").view(np.uint8).reshape(len(chosen), 16 * w)
        area[starts[chosen][:, None] + np.arange(16 * w)] = packed
    return b"".join([
        struct.pack("<II", n, len(place)), low.astype("<u4").tobytes(), width.astype(np.uint8).tobytes(),
        counts.astype(np.uint8).tobytes(), starts[:-1].astype("<u4").tobytes(), area.tobytes(),
        place.astype(np.uint8).tobytes(), high[block_of, place].astype("<u4").tobytes(),
    ])


def _layout(segment: bytes):
    n, exceptions = struct.unpack_from("<II", segment)
    blocks, at = -(-n // BLOCK), 8
    low = np.frombuffer(segment, "<u4", blocks, at)
    width = np.frombuffer(segment, np.uint8, blocks, at := at + 4 * blocks).astype(np.int64)
    counts = np.frombuffer(segment, np.uint8, blocks, at := at + blocks).astype(np.int64)
    starts = np.frombuffer(segment, "<u4", blocks, at := at + blocks).astype(np.int64)
    area = np.frombuffer(segment, np.uint8, int(width.sum()) * (BLOCK // 8), at := at + 4 * blocks)
    place = np.frombuffer(segment, np.uint8, exceptions, at := at + len(area))
    high = np.frombuffer(segment, "<u4", exceptions, at + exceptions)
    return n, low, width, counts, starts, area, place, high


def _unpack(area: np.ndarray, starts: np.ndarray, width: np.ndarray) -> np.ndarray:
    values = np.zeros((len(width), BLOCK), np.uint64)
    for w in np.unique(width):
        w = int(w)
        if w == 0:
            continue
        chosen = np.nonzero(width == w)[0]
        packed = area[starts[chosen][:, None] + np.arange(16 * w)]
        words = np.ascontiguousarray(np.ascontiguousarray(packed).view("<u8").reshape(len(chosen), 2 * w).T)
        lanes = np.empty((BLOCK, len(chosen)), np.uint64)
        for lane in range(BLOCK):
            word, shift = divmod(lane * w, 64)
            lanes[lane] = words[word] >> np.uint64(shift)
            if shift + w > 64:
                lanes[lane] |= words[word + 1] << np.uint64(64 - shift)
        values[chosen] = (lanes & np.uint64((1 << w) - 1)).T
    return values


def unpack(segment: bytes) -> np.ndarray:
    """All ids of a segment."""
    n, low, width, counts, starts, area, place, high = _layout(segment)
    values = _unpack(area, starts, width)
    block_of = np.repeat(np.arange(len(width)), counts)
    values[block_of, place] |= high.astype(np.uint64) << width[block_of].astype(np.uint64)
    return (values + low.astype(np.uint64)[:, None]).reshape(-1)[:n].astype("<u4")


def read_block(segment: bytes, block: int) -> np.ndarray:
    """The ids of one block, found by the index."""
    n, low, width, counts, starts, area, place, high = _layout(segment)
    values = _unpack(area, starts[block : block + 1], width[block : block + 1])[0]
    skip = int(counts[:block].sum())
    own = slice(skip, skip + int(counts[block]))
    values[place[own]] |= high[own].astype(np.uint64) << np.uint64(width[block])
    return (values + np.uint64(low[block]))[: min(BLOCK, n - block * BLOCK)].astype("<u4")


class WordEncoder:
    """The tokenizers library behind a bounded memo of words.

    The library's own splitting never lets a token span white space, nor two of the classes
    letters, single digits and others, so texts are cut there by vector operations and only
    distinct words reach it.  Of the unseen ones, words of Latin letters are encoded many
    to a call and told apart by the vocabulary's end-of-word mark; runs with any other
    character, an apostrophe or a ``<`` (which may begin a special token) go to the
    library as they are.
    """

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.memo = Memo(memo)
        vocabulary = self.library.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.kind = np.dtype("<u2" if len(self.closes) <= 1 << 16 else "<u4")
        # the same model for words that are normal and apart already
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )

    def _packed(self, encodings) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in encodings]

    def _simple(self, words: list[bytes]) -> list[bytes]:
        """Lower-case words of one class each, which are one word to the library."""
        out = []
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            ids = np.array(self.plain.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, self.kind)
            stops = (np.nonzero(self.closes[ids])[0] + 1).tolist()
            if len(stops) == len(some):
                packed, begins, size = ids.tobytes(), [0, *stops], self.kind.itemsize
                out += [packed[size * a : size * b] for a, b in zip(begins, stops)]
            else:  # a vocabulary that lacks some last letter
                out += self._packed(self.library.encode_batch_fast([w.decode() for w in some], add_special_tokens=False))
        return out

    def units(self, units: list[bytes], odd) -> list[bytes]:
        """Packed ids of each unit."""
        values = self.memo.get_all(units)
        missing = [k for k, v in enumerate(values) if v is None]
        simple, strange = [k for k in missing if not odd[k]], [k for k in missing if odd[k]]
        found = self._simple([units[k] for k in simple])
        for at in range(0, len(strange), 4096):
            some = [units[k].decode() for k in strange[at : at + 4096]]
            found += self._packed(self.library.encode_batch_fast(some, add_special_tokens=False))
        for k, value in zip(simple + strange, found):
            values[k] = value
            self.memo.add(units[k], value)
        return values

    def encode_column(self, column) -> Iterator[np.ndarray]:
        """The ids of each text of an Arrow column, in order; null is empty."""
        for _, cut, _, _ in cuts(column, b"'<", single_digits=True, fold=True):
            values = self.units(cut.distinct, cut.odd)
            sizes = np.fromiter(map(len, values), np.int64, len(values)) // self.kind.itemsize
            ids = spread(np.frombuffer(b"".join(values), self.kind), sizes, cut.of)
            ends = np.concatenate([[0], np.cumsum(sizes[cut.of])])[cut.bounds].tolist()
            yield from (ids[a:b] for a, b in zip(ends[:-1], ends[1:]))


_loaded: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _loaded:
        _loaded.clear()  # one vocabulary at a time
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def write_segments(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = END_ID, segment: int = SEGMENT, percentile: float = PERCENTILE,
) -> DataFrame:
    """Encode all texts in ascending id order and stage their segments."""
    end = np.array([end_id], "<u4")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_encoder(path)
        part, first = TaskContext.get().partitionId(), 0
        ids, lengths, pieces, held = [], [], [], 0
        key = None

        def close():
            nonlocal ids, lengths, pieces, held, first
            row = pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([held], pa.int64()),
                pa.array([ids], pa.list_(key)), pa.array([lengths], pa.list_(pa.int64())),
                pa.array([pack(np.concatenate(pieces), percentile)], pa.binary()),
            ], names=["part", "first", "n_ids", "doc_ids", "lengths", "segment"])
            first += held
            ids, lengths, pieces, held = [], [], [], 0
            return row

        for batch in batches:
            key = batch.column(0).type
            for doc, own in zip(batch.column(0).to_pylist(), coder.encode_column(batch.column(1))):
                ids.append(doc)
                lengths.append(len(own) + 1)
                pieces += [own.astype("<u4"), end]
                held += len(own) + 1
                if held >= segment:
                    yield close()
        if ids:
            yield close()

    # rows of one id, or without one, are dealt by their texts, so that no id is one task's
    tie = F.xxhash64(text_col).alias("__tie")
    dealt = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), tie).repartitionByRange("__id", "__tie")
    dealt = dealt.sortWithinPartitions("__id", "__tie").select("__id", "__text")
    return stage(dealt.mapInArrow(run, _SPEC.format(kind=kind)), "token-blocks", "none")


def read_documents(segments: DataFrame, with_ids: bool = False) -> DataFrame:
    """Read staged segments back: doc_id, start, n_tokens, ids_crc32 (and ids)."""
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()
    tail = ", ids array<long>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, _, docs, lengths, segment in zip(*(batch.column(i).to_pylist() for i in range(6))):
                ids = unpack(segment)
                stops = np.cumsum(lengths)
                begins = stops - lengths
                parts = [ids[a:b] for a, b in zip(begins, stops)]
                columns = [
                    pa.array([part] * len(docs), pa.int32()), pa.array(docs, batch.column(3).type.value_type),
                    pa.array(first + begins, pa.int64()), pa.array(lengths, pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in parts], pa.int64()),
                ]
                names = ["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int64) for x in parts], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    read = segments.mapInArrow(
        run, f"part int, doc_id {kind}, start_in_part long, n_tokens long, ids_crc32 long{tail}"
    )
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    joined = read.join(F.broadcast(offsets), "part")  # one row for each task that wrote
    return joined.select(
        "doc_id", (F.col("offset") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32",
        *(["ids"] if with_ids else []),
    )


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_documents(write_segments(docs, default_vocabulary()))
