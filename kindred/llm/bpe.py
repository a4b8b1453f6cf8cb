"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each leaf of the tree holds rank * width + position of the pair that starts at that symbol
(or NONE), each inner node the smaller of its two children. The root is thus the leftmost
pair of the lowest rank. A merge replaces one symbol and updates three leaves, each in
log2(width) steps; encoding ends when the root is NONE.

Words of up to BLOCK_WIDTH symbols are encoded together: one tree per row of an array, all
trees merging their root at once. Longer ones get a tree of their own. A batch of texts is
cut at white space into chunks; distinct chunks are encoded once and their ids are taken from
flat arrays, which a worker keeps up to MEMORY_BYTES.

Defined results: null text is an empty one; an empty text has no tokens and decodes to "".
Repeated rows give repeated results; other columns of the input are not read.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kindred.llm.arrow_rows import map_batches

NONE = np.iinfo(np.int64).max
BLOCK_WIDTH = 64
#: What a Python worker remembers of chunks met, in bytes, about; emptied when full.
MEMORY_BYTES = 24 << 20
#: Chunks looked up at a time.
GROUP_CHUNKS = 1 << 18
#: A vocabulary file is sent to every executor; larger ones than this are refused.
MAX_VOCABULARY_BYTES = 64 << 20
#: Bytes at which texts are cut into chunks, and all white space, at which chunks are cut once more.
SPACES = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
WHITE = regex.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from starts[i] on, counts[i] of them, for each i in turn."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class WordBpe:
    """A word-end BPE vocabulary in the JSON form of the tokenizers library."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = pa.array([tokens.get(i) for i in range(max(tokens) + 1)], pa.string())
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.raw = raw
        symbols = byte_symbols()
        self.byte_of = {c: b for b, c in enumerate(symbols)}
        self.inner = np.array([vocab[c] for c in symbols], np.int64)
        self.last = np.array([vocab[c + end] for c in symbols], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.base = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.merged = merged
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.forget()

    def forget(self) -> None:
        """Empties what is remembered of chunks: their entries, and the ids of each in flat arrays."""
        self.entries: dict[bytes, int] = {}
        self.starts, self.counts, self.flat, self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), 0

    @cached_property
    def library(self) -> Tokenizer:
        """The library's own tokenizer; only its normaliser and pre-tokeniser are used."""
        return Tokenizer.from_str(self.raw.decode())

    # -- pair ranks ------------------------------------------------------------------

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; NONE where they don't merge."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    # -- one word --------------------------------------------------------------------

    def merge_one(self, ids: list[int]) -> list[int]:
        """Encodes one word, given as its initial symbols."""
        n = len(ids)
        if n < 2:
            return list(ids)
        width = 1 << (n - 1).bit_length()
        sym, after, before = list(ids), [*range(1, n + 1)], [*range(-1, n - 1)]
        get, none = self.rank_of.get, width * (len(self.rank_of) + 1)
        tree = [none] * (2 * width)

        def leaf(i: int) -> int:
            if after[i] >= n:
                return none
            r = get(sym[i] * self.base + sym[after[i]])
            return none if r is None else r * width + i

        for i in range(n):
            tree[width + i] = leaf(i)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            while k > 1:
                k >>= 1
                tree[k] = min(tree[2 * k], tree[2 * k + 1])

        while (root := tree[1]) < none:
            rank, i = divmod(root, width)
            gone = after[i]
            sym[i], after[i] = int(self.merged[rank]), after[gone]
            if after[gone] < n:
                before[after[gone]] = i
            put(gone, none)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        out, i = [], 0
        while i < n:
            out.append(sym[i])
            i = after[i]
        return out

    # -- many words ------------------------------------------------------------------

    def merge_block(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Encodes words of at most `width` symbols together; width is a power of two.

        Returns all ids, and how many belong to each word.
        """
        n = len(starts)
        inside = np.arange(width) < lengths[:, None]
        sym = np.zeros((n, width + 1), np.int64)
        sym[:, :width][inside] = symbols[(starts[:, None] + np.arange(width))[inside]]
        after = np.minimum(np.arange(1, width + 2), width) * np.ones((n, 1), np.int64)
        after[:, :width] = np.where(after[:, :width] < lengths[:, None], after[:, :width], width)
        before = np.tile(np.arange(-1, width), (n, 1))
        tree = np.full((n, 2 * width), NONE, np.int64)
        rank = self._rank(sym[:, : width - 1], sym[:, 1:width])
        pair = inside[:, 1:] & (rank != NONE)
        tree[:, width : 2 * width - 1] = np.where(pair, np.where(pair, rank, 0) * width + np.arange(width - 1), NONE)
        for k in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])

        def put(rows, at, value):
            k = width + at
            tree[rows, k] = value
            while k[0] > 1:
                k = k >> 1
                tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])

        def leaf(rows, at):
            nxt = after[rows, at]
            r = self._rank(sym[rows, at], sym[rows, nxt])
            ok = (nxt < width) & (r != NONE)
            return np.where(ok, np.where(ok, r, 0) * width + at, NONE)

        rows = np.flatnonzero(tree[:, 1] != NONE)
        while len(rows):
            root = tree[rows, 1]
            at = root % width
            gone = after[rows, at]
            nxt = after[rows, gone]
            sym[rows, at] = self.merged[root // width]
            after[rows, at] = nxt
            before[rows, nxt] = at
            put(rows, gone, NONE)
            put(rows, at, leaf(rows, at))
            prev = before[rows, at]
            has = prev >= 0
            if has.any():
                put(rows[has], prev[has], leaf(rows[has], prev[has]))
            rows = rows[tree[rows, 1] != NONE]
        alive = np.zeros((n, width + 1), bool)
        alive[:, 0] = lengths > 0
        at = np.zeros(n, np.int64)
        left = np.flatnonzero(lengths > 0)
        while len(left):
            at[left] = after[left, at[left]]
            left = left[at[left] < width]
            alive[left, at[left]] = True
        return sym[alive], alive.sum(1)

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words given as bytes, in their order, and how many belong to each word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols, ends = self.inner[raw], np.cumsum(lengths)
        final = ends[lengths > 0] - 1
        symbols[final] = self.last[raw[final]]
        starts = ends - lengths
        members, counts, flat = [], [], []
        low = 0
        while low < BLOCK_WIDTH:
            width = max(2, 2 * low)
            chosen = np.flatnonzero((lengths > low) & (lengths <= width))
            for lo in range(0, len(chosen), 8192):
                part = chosen[lo : lo + 8192]
                ids, n = self.merge_block(symbols, starts[part], lengths[part], width)
                members.append(part)
                counts.append(n)
                flat.append(ids)
            low = width
        for i in np.flatnonzero(lengths > BLOCK_WIDTH).tolist():
            ids = self.merge_one(symbols[starts[i] : ends[i]].tolist())
            members.append([i])
            counts.append([len(ids)])
            flat.append(ids)
        if not members:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        members, counts = np.concatenate(members), np.concatenate(counts).astype(np.int64)
        begin, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        begin[members], total[members] = np.cumsum(counts) - counts, counts
        return np.concatenate(flat).astype(np.int32)[spread(begin, total)], total

    # -- texts -----------------------------------------------------------------------

    def _parts(self, chunk: str) -> list[int | str]:
        """Special ids and words of a piece of text without white space."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk.lower()]
            if chunk[:-1].isalpha():
                return [chunk[:-1].lower(), chunk[-1]]
        out: list[int | str] = []
        for part in self.split_special.split(chunk) if self.split_special and any(x in chunk for x in self.special) else [chunk]:
            if part in self.special:
                out.append(self.special[part])
            elif part and max(part) < "\u0250":
                out += self.pieces.findall(unicodedata.normalize("NFC", part).lower())
            elif part:
                # beyond Latin letters, character classes follow the Unicode version of the library
                plain = self.library.normalizer.normalize_str(part)
                out += [bytes(map(self.byte_of.__getitem__, p)).decode() for p, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]
        return out

    def _encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of chunks without ASCII white space, and how many belong to each chunk."""
        order: dict[int | str, int] = {}
        pieces, lengths = [], []
        for chunk in chunks:
            text = chunk.decode()
            found = self._parts(text) if text.isascii() else [p for w in WHITE.split(text) if w for p in self._parts(w)]
            pieces += [order.setdefault(p, len(order)) for p in found]
            lengths.append(len(found))
        words = {i: p for p, i in order.items() if isinstance(p, str)}
        flat, n = self.merge_all([w.encode() for w in words.values()])
        begin, total = np.zeros(len(order), np.int64), np.ones(len(order), np.int64)
        begin[list(words)], total[list(words)] = np.cumsum(n) - n, n
        special = [p for p in order if not isinstance(p, str)]
        begin[[order[p] for p in special]] = len(flat) + np.arange(len(special))
        flat = np.concatenate([flat, np.array(special, np.int32)])
        at = np.array(pieces, np.int64)
        owner = np.repeat(np.arange(len(chunks)), lengths)
        counts = np.bincount(owner, total[at], len(chunks)).astype(np.int64)
        return flat[spread(begin[at], total[at])], counts

    def _entries_of(self, chunks: list[bytes]) -> np.ndarray:
        """Where the ids of distinct chunks are remembered; new ones are encoded first."""
        new = [c for c in chunks if c not in self.entries]
        if self.held + sum(map(len, new)) + 120 * len(new) > MEMORY_BYTES:
            self.forget()
            new = chunks
        if new:
            flat, counts = self._encode_chunks(new)
            self.entries.update(zip(new, range(len(self.starts), len(self.starts) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
            self.counts, self.flat = np.concatenate([self.counts, counts]), np.concatenate([self.flat, flat])
            self.held += sum(map(len, new)) + 120 * len(new) + flat.nbytes
        return np.fromiter(map(self.entries.__getitem__, chunks), np.int64, len(chunks))

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each whole text of a string array; nulls are empty texts."""
        texts = pc.fill_null(texts, "")
        n = len(texts)
        ends = np.frombuffer(texts.buffers()[1], np.int32, n + 1, 4 * texts.offset).astype(np.int64) if n else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
        ends -= ends[0]
        word = ~SPACES[data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        border = ends[(ends > 0) & (ends < len(data))]  # chunks end with their text
        first[border], last[border - 1] = word[border], word[border - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        ids, counts = [np.zeros(0, np.int32)], np.zeros(len(start), np.int64)
        for lo in range(0, len(start), GROUP_CHUNKS):
            hi = min(len(start), lo + GROUP_CHUNKS)
            a, z = start[lo], end[hi - 1]
            offsets = np.concatenate([[0], np.cumsum(end[lo:hi] - start[lo:hi])]).astype(np.int32)
            buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data[a:z][word[a:z]])]
            chunks = pa.Array.from_buffers(pa.binary(), hi - lo, buffers).dictionary_encode()
            at = self._entries_of(chunks.dictionary.to_pylist())[chunks.indices.to_numpy()]
            counts[lo:hi] = self.counts[at]
            ids.append(self.flat[spread(self.starts[at], counts[lo:hi])])
        before = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(start, ends)]
        return pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(np.concatenate(ids)))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Tokens of each list joined by spaces, as a vocabulary without decoder gives them.

        Null lists are empty texts; unknown and null ids are left out.
        """
        flat, ends = ids.flatten(), pc.fill_null(pc.list_value_length(ids), 0).to_numpy().cumsum()
        bad = pc.fill_null(pc.or_(pc.less(flat, 0), pc.greater_equal(flat, len(self.tokens))), True)
        tokens = self.tokens.take(pc.if_else(bad, pa.scalar(None, flat.type), flat))
        if tokens.null_count:
            known = tokens.is_valid().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(known)])[ends]
            tokens = tokens.drop_null()
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), tokens)
        return pc.binary_join(lists, " ")


_loaded: dict[str, WordBpe] = {}


def _model(held) -> WordBpe:
    """A worker parses the broadcast vocabulary once and keeps the words it has met."""
    key = str(held.id if hasattr(held, "id") else id(held))
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordBpe(held.value)
    return _loaded[key]


class _Held:
    """A broadcast with a key that survives pickling."""

    def __init__(self, broadcast, key):
        self.broadcast, self.id = broadcast, key

    @property
    def value(self):
        return self.broadcast.value


def read_vocabulary(spark, path: str) -> _Held:
    """Reads the vocabulary file on the driver and broadcasts it; its size is checked."""
    import hashlib

    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return _Held(spark.sparkContext.broadcast(raw), hashlib.sha256(raw).hexdigest())


def bpe_encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and `ids array<int>` of every whole text; null texts have no ids."""
    held = read_vocabulary(df.sparkSession, vocabulary)

    def encode(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), _model(held).encode(b.column(1))], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, F.col(text_col).cast("string")), encode, f"`{id_col}` {kind}, ids array<int>")


def bpe_decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, ids and `decoded string`; null ids decode to an empty text."""
    held = read_vocabulary(df.sparkSession, vocabulary)

    def decode(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns, _model(held).decode(b.column(1))], names=[id_col, "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, F.col(ids_col).alias("ids")), decode, f"`{id_col}` {kind}, ids array<int>, decoded string")


def bpe_round_trip(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bpe_decode of bpe_encode in one pass: id_col, ids and `decoded string` of every whole text."""
    held = read_vocabulary(df.sparkSession, vocabulary)

    def both(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = _model(held).encode(b.column(1))
        return pa.RecordBatch.from_arrays([b.column(0), ids, _model(held).decode(ids)], names=[id_col, "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, F.col(text_col).cast("string")), both, f"`{id_col}` {kind}, ids array<int>, decoded string")
