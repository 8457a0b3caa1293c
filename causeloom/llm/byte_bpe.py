"""Byte-level BPE by prefix dynamic programming.

For a vocabulary of merge ranks every byte string has one valid encoding: the one
in which each two neighbouring tokens, merged from scratch, fall apart into just
these two.  So every *prefix* of a piece has one valid last token: the token that
ends there and is compatible with the last token of the prefix before it.  The
table of last tokens

* encodes a piece by walking back from its end,
* is extended, never recomputed, when bytes are appended, and
* is recomputed only near an edit: once as many entries as the longest token has
  bytes agree with the old table, all later ones do.

Texts are cut by the split pattern first; each piece has its own table.

Distribution: a map over rows; nothing is shuffled.  A worker holds the rank
tables (read where it runs, from a path parameter) and a bounded memo of encoded
words.  Defined results: a null text is the empty text and has no tokens; very
long texts are encoded whole, in time linear in their length; repeated rows are
encoded each; further columns are carried by :func:`tokenize` only if asked for.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .caching import Memo
from .columns import apart
from .prefix_tables import PrefixTables
from .staging import give_back
from .units import cuts, spread

#: Bytes that one worker's memo of words takes at most.
MEMO = 32 << 20
#: Rows that are encoded together, and bytes of a long piece that are extended together.
ROWS, RUN = 512, 1 << 16
# The one split pattern that is cut by vector operations, and the white space beyond ASCII.
FAST_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WIDE_BLANK = regex.compile("[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WIDE_LEADS = [0xC2, 0xE1, 0xE2, 0xE3]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBpe:
    """One vocabulary: prefix tables, encoding, decoding."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, pattern
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.longest = max(map(len, ranks), default=1)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.tables = PrefixTables(ranks)

    def merged(self, piece: bytes) -> list[int]:
        """Tokens by the definition: merge the leftmost pair of lowest rank until none is left."""
        ranks, parts = self.ranks, [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def extend(self, data: bytes, last: list[int], stop: int | None = None) -> list[int]:
        """Fill ``last`` (the valid last token of each prefix, by its end) up to ``stop``."""
        stop = len(data) if stop is None else stop
        known: dict[tuple[int, int], bool] = {}
        while len(last) < stop:
            self._extend(data, last, min(stop, len(last) + RUN), known)
        return last

    def _extend(self, data: bytes, last: list[int], stop: int, known: dict) -> None:
        """Tokens are found by walking the trie from all places at once; then each end takes its one compatible token."""
        tables, low, done = self.tables, max(0, len(last) + 1 - self.longest), len(last)
        text = np.frombuffer(data[low:stop], np.uint8)
        at = np.arange(len(text))
        state, ends, starts, tokens = np.zeros(len(text), np.int64), [], [], []
        depth = 0
        while len(at):
            state = tables.step((state << 8 | text[at + depth]).astype(np.uint64)).astype(np.int64)
            depth += 1
            alive = state >= 0
            at, state = at[alive], state[alive]
            hit = np.nonzero((tables.token_of[state] >= 0) & (at + depth + low > done))[0]
            ends.append(at[hit] + depth + low)
            starts.append(at[hit] + low)
            tokens.append(tables.token_of[state[hit]])
            inside = at + depth < len(text)
            at, state = at[inside], state[inside]
        ends, starts, tokens = map(np.concatenate, (ends, starts, tokens))
        order = np.lexsort((starts, ends))  # longest tokens first
        sound, compatible = tables.sound, self.compatible
        for end, start, token in zip(ends[order].tolist(), starts[order].tolist(), tokens[order].tolist()):
            if len(last) >= end:
                continue
            if len(last) != end - 1:
                break
            if start == 0:
                fits = sound[token]
            else:
                pair = last[start - 1], token
                fits = known.get(pair)
                if fits is None:
                    fits = known[pair] = compatible(*pair)
            if fits:
                last.append(token)
        if len(last) != stop:
            raise ValueError("the vocabulary lacks a single byte")

    def compatible(self, a: int, b: int) -> bool:
        """Whether two tokens side by side are the encoding of their bytes; see ``prefix_tables``."""
        tables, ranks, spelled, before = self.tables, self.ranks, self.bytes_of, 1 << 40
        while True:
            across = ranks.get(spelled[a] + spelled[b])
            if across is not None and across < before:
                return False
            if tables.left[a] >= 0 and (tables.left[b] < 0 or a > b):
                before, a = a, int(tables.right[a])
            elif tables.left[b] >= 0:
                before, b = b + 1, int(tables.left[b])
            else:
                return True

    def walk(self, last: list[int]) -> list[int]:
        """Tokens of the prefix that ``last`` covers."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[last[end - 1]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.walk(self.extend(piece, []))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.pattern.findall(text):
            out += self.encode_piece(piece.encode("utf-8"))
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class PrefixTable:
    """The last tokens of one piece, kept exact under appends and edits."""

    def __init__(self, bpe: ByteBpe, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, data, bpe.extend(data, [])
        self.recomputed = len(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.bpe.extend(self.data, self.last)
        self.recomputed = len(more)

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Replace ``data[start:stop]``; only prefixes near the edit are computed again."""
        old, shift, window = self.last, len(new) - (stop - start), self.bpe.longest
        data = self.data[:start] + new + self.data[stop:]
        last, same, settled = old[:start], 0, None
        while len(last) < len(data) and settled is None:
            done = len(last)
            self.bpe.extend(data, last, min(len(data), done + window))
            for end in range(done + 1, len(last) + 1):
                same = same + 1 if end > start + len(new) and old[end - 1 - shift] == last[end - 1] else 0
                if same >= window:
                    settled = len(last)
                    break
        self.recomputed = len(last) - start
        self.data, self.last = data, last if settled is None else last + old[settled - shift :]

    def tokens(self) -> list[int]:
        whole = self.bpe.ranks.get(self.data)
        return [whole] if whole is not None else self.bpe.walk(self.last)


class EditableText:
    """Tokens of a text under appends and edits; only pieces near the change are encoded again."""

    def __init__(self, bpe: ByteBpe, text: str = ""):
        self.bpe, self.text = bpe, text
        self.pieces = [(m.start(), m.end(), bpe.encode_piece(m.group().encode())) for m in bpe.pattern.finditer(text)]

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, stop: int, new: str) -> None:
        text, shift = self.text[:start] + new + self.text[stop:], len(new) - (stop - start)
        keep = 0
        while keep < len(self.pieces) and self.pieces[keep][1] < start:
            keep += 1
        keep = max(0, keep - 2)  # a contraction reaches back over two pieces
        head = self.pieces[:keep]
        later = {p[0] + shift: i for i, p in enumerate(self.pieces) if p[0] >= stop}
        at = head[-1][1] if head else 0
        while at < len(text):
            if at >= start + len(new) and at in later:
                head += [(a + shift, b + shift, ids) for a, b, ids in self.pieces[later[at] :]]
                break
            m = self.bpe.pattern.match(text, at)
            head.append((m.start(), m.end(), self.bpe.encode_piece(m.group().encode())))
            at = m.end()
        self.text, self.pieces = text, head

    def tokens(self) -> list[int]:
        return [i for _, _, ids in self.pieces for i in ids]


class TextEncoder:
    """Encodes whole columns of texts.

    Texts are cut into words by vector operations where they hold no white space beyond
    ASCII (their cut is then the split pattern's, which is checked to be the one that
    this holds for); other texts, and words of other scripts, are cut by the pattern.
    The distinct pieces that the memo lacks are encoded together, by their prefix tables.
    """

    def __init__(self, bpe: ByteBpe, memo: int = MEMO):
        self.bpe = bpe
        self.kind = np.dtype("<u2" if max(bpe.bytes_of, default=0) < 1 << 16 else "<u4")
        self.memo = Memo(memo)
        self.fast = bpe.split == FAST_PATTERN

    def pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Packed ids of distinct pieces."""
        order, ids, counts = self.bpe.tables.encode(pieces)
        packed, ends = ids.astype(self.kind).tobytes(), (np.cumsum(counts) * self.kind.itemsize).tolist()
        out, begin = {}, 0
        for k, end in zip(order, ends):
            out[pieces[k]] = packed[begin:end]
            begin = end
        if len(out) < len(pieces):
            for piece in pieces:
                if piece not in out:
                    out[piece] = np.array(self.bpe.encode_piece(piece), self.kind).tobytes()
        return out

    def units(self, units: list[bytes], odd) -> list[bytes]:
        """Packed ids of each unit; an odd one is cut by the pattern first."""
        values = self.memo.get_all(units)
        missing = [k for k, v in enumerate(values) if v is None]
        if missing:
            split = self.bpe.pattern.findall
            plain = [units[k] for k in missing if not odd[k]]
            parts = {k: [p.encode() for p in split(units[k].decode())] for k in missing if odd[k]}
            packed = self.pieces(list(set(plain).union(*parts.values())))
            for k in missing:
                own = parts.get(k)
                values[k] = packed[units[k]] if own is None else b"".join([packed[p] for p in own])
                self.memo.add(units[k], values[k])
        return values

    def encode_column(self, column) -> Iterator[np.ndarray]:
        """The ids of each text of an Arrow column, in order; null is empty."""
        for _, cut, data, edges in cuts(column, b"'", glue=True):
            wide = self._wide(data, edges)
            values = self.units(cut.distinct, cut.odd) if not wide.all() else [b""] * len(cut.distinct)
            sizes = np.fromiter(map(len, values), np.int64, len(values)) // self.kind.itemsize
            ids = spread(np.frombuffer(b"".join(values), self.kind), sizes, cut.of)
            ends = np.concatenate([[0], np.cumsum(sizes[cut.of])])[cut.bounds].tolist()
            for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                if wide[k]:
                    text = data[edges[k] : edges[k + 1]].tobytes().decode()
                    own = [p.encode() for p in self.bpe.pattern.findall(text)]
                    packed = self.pieces(list(set(own)))
                    yield np.frombuffer(b"".join([packed[p] for p in own]), self.kind)
                else:
                    yield ids[a:b]

    def _wide(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Which texts the pattern must cut as a whole."""
        out = np.full(len(edges) - 1, not self.fast)
        if self.fast:
            leads = np.nonzero(np.isin(data, _WIDE_LEADS))[0] if len(data) and data.max() >= 0xC2 else []
            if len(leads):
                for k in np.unique(np.searchsorted(edges, leads, side="right") - 1).tolist():
                    out[k] = WIDE_BLANK.search(data[edges[k] : edges[k + 1]].tobytes().decode()) is not None
        return out


_loaded: dict[tuple[str, str], TextEncoder] = {}


def encoder(path: str, pattern: str) -> TextEncoder:
    """The encoder of this process for a rank file."""
    if (path, pattern) not in _loaded:
        _loaded.clear()  # one vocabulary at a time
        _loaded[path, pattern] = TextEncoder(ByteBpe(read_ranks(path), pattern))
    return _loaded[path, pattern]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def tokenize(
    docs: DataFrame, path: str | None = None, pattern: str | None = None,
    text_col: str = "text", keep: list[str] | None = None, digests: bool = False, ids: bool = True,
) -> DataFrame:
    """Encode and decode every text.

    Returns the columns ``keep`` (all but the text), those that clash with a result's name as
    ``name_input``, and: ``ids`` array<int> (if asked for), ``n_tokens``,
    ``round_trip`` (the decoded bytes are the text's), and with ``digests`` the
    SHA-256 of the ids, written in decimal and joined by blanks, and of the decoded
    bytes.
    """
    vocabulary = (path, pattern) if path and pattern else default_vocabulary()
    spec = "n_tokens long, round_trip boolean" + ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string" * digests
    names = [f.split()[0] for f in spec.split(", ")]
    if keep is not None:
        docs = docs.select(*keep, *[text_col] * (text_col not in keep))
    carried = keep is not None and text_col in keep
    docs = apart(docs, names, own=[text_col])
    keep = [c for c in docs.columns if c != text_col or carried]
    fields = [docs.schema[c] for c in keep]
    schema = docs.sparkSession.createDataFrame([], spec).schema
    for f in reversed(fields):
        schema.fields.insert(0, f)
    schema.names = [f.name for f in schema.fields]
    schema._needConversion = [f.dataType.needConversion() for f in schema.fields]

    kinds = {"n_tokens": pa.int64(), "round_trip": pa.bool_(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(*vocabulary)
        spelled = [b"%d" % i for i in range(max(coder.bpe.bytes_of, default=-1) + 1)] if digests else None
        for batch in batches:
            for part in range(0, batch.num_rows, ROWS):
                yield one(coder, spelled, batch.slice(part, ROWS))
        coder.memo = Memo(coder.memo.limit * 2)  # a worker lives on; its words' memory is given back
        give_back()

    def one(coder, spelled, batch):
        out: dict[str, list] = {n: [] for n in names}
        found, texts = [], batch.column(len(keep))
        token = coder.bpe.bytes_of.__getitem__
        for text, tokens in zip(texts, coder.encode_column(texts)):
            listed = tokens.tolist()
            decoded = b"".join(map(token, listed))
            out["n_tokens"].append(len(listed))
            out["round_trip"].append(decoded == (text.as_py() or "").encode())
            if ids:
                found.append(tokens.astype("<i4"))
            if digests:
                out["ids_sha256"].append(hashlib.sha256(b" ".join(map(spelled.__getitem__, listed))).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
        columns = [batch.column(i) for i in range(len(keep))]
        for name in names:
            if name == "ids":
                offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype("<i4")
                flat = np.concatenate(found) if found else np.empty(0, "<i4")
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
            else:
                columns.append(pa.array(out[name], kinds[name]))
        return pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    return docs.select(*keep, F.col(text_col)).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return tokenize(docs, digests=True, ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip")
