"""Removal of every byte covered by a long string that also starts anywhere else.

A text is a sequence of symbols: its bytes in UTF-8 for the strings of LENGTH bytes that are
removed (`remove_repeats`), its words for passages of PASSAGE words that are reported
(`word_passages`). Both go the same way.

A string is judged by a sparse suffix index. Each of its starts belongs to an anchor: the gram
(GRAM bytes, PASSAGE_GRAM words) of smallest hash inside the string. Equal strings have equal
anchors at equal places, so only occurrences of one anchor need comparing. For every anchor a
document holds a run of string starts; runs with equal symbols around them are one signature: a
cryptographic digest of 128 bits of all symbols of the run and the anchor's place in it.

 1. Signatures that a document holds twice repeat in full; one of them stays to be met by others,
    and the stretches are merged. So periodic texts have few rows, however long they are.
 2. Anchors that occur once in the corpus are dropped. A signature that occurs twice repeats in full.
 3. Where an anchor has several signatures, one occurrence of each gives the symbols of its
    run. They go to the logarithmic index family of the anchor's partition: new batches get
    suffix arrays, are merge-scanned against the existing levels for matches of full length,
    and levels of equal size merge. What decides there are the symbols themselves.
 4. What repeats is carried back to every occurrence, and documents drop the bytes covered.

`add_batch` does the same for documents that come later: earlier batches are levels of stored
tables (texts, and anchors sorted by gram), of which each is at least twice as large as the next.
A batch is merged with the levels' rows of its own anchors alone, and levels of equal size merge.

An anchor with more than CROWD signatures would be too much for one task. Its runs are dealt
further before they are indexed: each is cut at the middle of the possible offsets. What all
strings of a half have in common (its core) is longer than the anchor and takes its place as
the key; halves whose core no other run has are dropped, equal halves become one signature
again, and halves that are still crowded are cut once more. After log2(LENGTH) cuts a core is a
whole string, so every crowd ends.

Offsets and lengths are bytes of the text in UTF-8. Matches never cross documents. Hashes of grams
and cores only bring together what may be equal: unequal ones that share a hash cost time, no more.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.arrow_rows import bounded_batches, map_batches
from kindred.plans.sizes import broadcast_if_small
from kindred.plans.stored import drop, scratched, stored

#: Bytes of a string that is removed where it repeats, and of the anchors.
LENGTH, GRAM = 400, 128
#: Words of a passage that is reported where it repeats, and of the anchors.
PASSAGE, PASSAGE_GRAM = 51, 10
#: Text positions handled at once within a document; bounds memory on very long texts.
SEGMENT = 1 << 18
#: Signatures of one anchor that one task takes; and strings that a task's index holds, about.
CROWD = 2000
TASK_STRINGS = 100_000
#: Strings of a new batch of the index.
BATCH_STRINGS = 32_768
#: Anchors, or signatures with their result, that are broadcast (some 50 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 200_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.RandomState(5).randint(0, 2**62, 256, np.int64).astype(np.uint64) * np.uint64(4) + np.uint64(1)
_SPACES = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        ones = np.ones(size, np.uint64)
        _powers[:] = [np.concatenate([ones[:1], np.multiply.accumulate(ones[1:] * x)]) for x in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def _mixed(x):
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


# Primes below 2^31 and bases.
_PRIMES = ((2147483647, 1103515245), (2147483629, 1406932606))
_of_primes: dict[int, np.ndarray] = {}


def _prime_powers(k: int, n: int) -> np.ndarray:
    prime, base = _PRIMES[k]
    held = _of_primes.get(k, np.ones(1, np.uint64))
    while len(held) < n:  # doubled: the second half is the first one times a power
        step = np.uint64(pow(base, len(held), prime))
        held = np.concatenate([held, held * step % np.uint64(prime)])
    _of_primes[k] = held
    return held


class _Hashes:
    """Hashes of all substrings of some symbols (odd 64-bit values), from sums over prefixes."""

    def __init__(self, symbols: np.ndarray):
        power, self.inverse = _power(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * power[: len(symbols)], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return _mixed((self.sums[start + length] - self.sums[start]) * self.inverse[start] + np.asarray(length).astype(np.uint64))


def word_symbols(data: np.ndarray) -> np.ndarray:
    """A number for each word (run of anything but ASCII white space) of some bytes, which end with a word.

    It holds the remainders of two polynomials modulo primes; a polynomial modulo a power of two
    has the same value for some regular words, whatever its base.
    """
    word = ~_SPACES[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    lengths = np.flatnonzero(last) + 1 - np.flatnonzero(first)
    if not len(lengths):
        return np.zeros(0, np.uint64)
    starts = np.cumsum(lengths) - lengths
    at = np.arange(starts[-1] + lengths[-1]) - np.repeat(starts, lengths)
    values, longest = data[word].astype(np.uint64) + np.uint64(1), int(lengths.max())
    high, low = (np.add.reduceat(values * _prime_powers(k, longest)[at], starts) % np.uint64(_PRIMES[k][0]) for k in (0, 1))
    return (high << np.uint64(32)) | low


class Kind:
    """Bytes or words as the symbols of texts; a run is kept as bytes, `width` of them a symbol."""

    def __init__(self, words: bool, length: int, gram: int):
        self.words, self.length, self.gram, self.width = words, length, gram, 8 if words else 1

    def raw(self, data: bytes) -> np.ndarray:
        """The symbols of a text, as an array whose bytes are compared."""
        whole = np.frombuffer(data, np.uint8)
        if not self.words:
            return whole
        parts, lo = [], 0
        while lo < len(whole):  # in pieces that end with a word, for memory's sake
            hi = lo + SEGMENT
            while hi < len(whole):
                spaces = np.flatnonzero(_SPACES[whole[hi : hi + SEGMENT]])
                hi += int(spaces[0]) if len(spaces) else SEGMENT
                if len(spaces):
                    break
            parts.append(word_symbols(whole[lo:hi]))
            lo = hi
        return np.concatenate(parts).astype(">u8") if parts else np.zeros(0, ">u8")

    def values(self, raw: np.ndarray) -> np.ndarray:
        return raw.astype(np.uint64) | np.uint64(1) if self.words else _BYTES[raw]

    def of_run(self, run: bytes) -> np.ndarray:
        return np.frombuffer(run, ">u8" if self.words else np.uint8)

    def long_enough(self, data: bytes) -> bool:
        return len(data) >= (2 * self.length - 1 if self.words else self.length)

    @property
    def strings(self) -> str:
        """SQL for the number of strings of a run."""
        return f"(octet_length(run) div {self.width} - {self.length - 1})"


def signed(run, offset: int) -> bytes:
    """Equal for equal runs (bytes) with their anchor at equal offsets."""
    return blake2b(run, digest_size=16, salt=offset.to_bytes(8, "little", signed=True)).digest()


def anchors(raw: np.ndarray, kind: Kind) -> list[np.ndarray]:
    """Per anchor: hash of its gram, both halves of its signature, its position, first and last start of its run of strings."""
    length, gram = kind.length, kind.gram
    span = length - gram + 1
    found: list[list[np.ndarray]] = []
    view, w = memoryview(raw.tobytes()), kind.width
    for base in range(0, len(raw) - length + 1, SEGMENT):
        part = kind.values(raw[base : base + SEGMENT + length - 1])
        n = len(part) - length + 1
        grams = _Hashes(part).of(np.arange(len(part) - gram + 1), gram)
        # the smallest (hash, position) of each run of `span` grams, from minima within blocks
        key = (grams & ~np.uint64(0xFFFFF)) | np.arange(len(grams), dtype=np.uint64)
        blocks = np.full(-(-len(key) // span) * span, ~np.uint64(0), np.uint64)
        blocks[: len(key)] = key
        blocks = blocks.reshape(-1, span)
        forward = np.minimum.accumulate(blocks, axis=1).ravel()
        backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(backward[:n], forward[span - 1 : span - 1 + n]) & np.uint64(0xFFFFF)).astype(np.int64)
        lo = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        hi = np.concatenate([lo[1:] - 1, [n - 1]])
        at = at[lo]
        signs = b"".join([signed(view[w * (base + a) : w * (base + z + length)], p - a) for a, z, p in zip(lo.tolist(), hi.tolist(), at.tolist(), strict=True)])
        halves = np.frombuffer(signs, np.uint64).reshape(-1, 2)
        found.append([_mixed(grams[at]), halves[:, 0], halves[:, 1], at + base, lo + base, hi + base])
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else []


class LogSuffixIndex:
    """Suffix arrays of batches in levels of doubling size.

    A level holds text and, in the order of the strings that start there, offsets into it with
    their names; strings are cut out of the text only while they are compared. Adding a batch
    finds which of its strings occur in any level or twice in the batch, and which entries of
    the levels occur in the batch.
    """

    def __init__(self, length: int):
        self.length = length
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = []

    def _strings(self, text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The strings at some offsets, as values that compare byte by byte."""
        rows = np.lib.stride_tricks.sliding_window_view(text, self.length)[offsets] if len(offsets) else np.zeros((0, self.length), np.uint8)
        return np.ascontiguousarray(rows).view(f"S{self.length}").ravel()

    def add(self, text: np.ndarray, offsets: np.ndarray, names: np.ndarray) -> np.ndarray:
        """text: bytes; offsets: where strings start; names: theirs. Returns the names that now have a match."""
        if not len(offsets):
            return np.zeros(0, np.int64)
        rows = self._strings(text, offsets)
        order = np.argsort(rows, kind="stable")
        rows, offsets, names = rows[order], offsets[order], names[order]
        same = rows[1:].view(f"V{self.length}") == rows[:-1].view(f"V{self.length}")
        matched = [names[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
        for level in self.levels:
            if level is not None:
                keys = self._strings(level[0], level[1])
                left = np.searchsorted(keys, rows, "left")
                there = keys[np.minimum(left, len(keys) - 1)]
                hit = (left < len(keys)) & (there.view(f"V{self.length}") == rows.view(f"V{self.length}"))
                matched.append(names[hit])
                cover = np.zeros(len(keys) + 1, np.int64)
                np.add.at(cover, left[hit], 1)
                np.add.at(cover, np.searchsorted(keys, rows[hit], "right"), -1)
                matched.append(level[2][np.cumsum(cover)[:-1] > 0])
        held, k = (text, offsets, names, rows), 0
        while k < len(self.levels) and self.levels[k] is not None:
            held = self._merged(self.levels[k], held)
            self.levels[k] = None
            k += 1
        if k == len(self.levels):
            self.levels.append(None)
        self.levels[k] = held[:3]
        return np.unique(np.concatenate(matched))

    def _merged(self, level, held):
        """A level and a batch as one: their texts one after the other, their offsets in one order."""
        text, offsets, names = level
        keys, rows = self._strings(text, offsets), held[3]
        to = np.searchsorted(keys, rows, "right") + np.arange(len(rows))
        rest = np.ones(len(keys) + len(rows), bool)
        rest[to] = False
        out = [np.empty(len(rest), held[1].dtype), np.empty(len(rest), np.int64), np.empty(len(rest), rows.dtype)]
        for x, new, old in zip(out, (held[1] + len(text), held[2], rows), (offsets, names, keys), strict=True):
            x[to], x[rest] = new, old
        return np.concatenate([text, held[0]]), *out


_ANCHORS = "id {0}, h long, g long, sig binary, n long, at long, lo long, hi long"
_RUN = "g long, sig binary, base long, run binary"


def _anchor_rows(b: pa.RecordBatch, kind: Kind) -> pa.RecordBatch:
    """Anchors of each document, of equal ones (g, sig) one with their number n; g is null for stretches of starts that repeat in the document."""
    rows, parts = [], []
    for i, text in enumerate(b.column(1).to_pylist()):
        data = (text or "").encode()
        if kind.long_enough(data):
            found = anchors(kind.raw(data), kind)
            if found:
                parts.append(found)
                rows.append(np.full(len(found[0]), i))
    g, s, z, at, lo, hi = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.uint64)] * 3 + [np.zeros(0, np.int64)] * 3
    row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    order = np.lexsort((lo, z, s, g, row))
    g, s, z, at, lo, hi, row = (x[order] for x in (g, s, z, at, lo, hi, row))
    new = np.ones(len(g), bool)
    new[1:] = (row[1:] != row[:-1]) | (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (z[1:] != z[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(g)))
    # what repeats in its document, as stretches of starts in the documents' order
    own = np.flatnonzero(np.repeat(times > 1, times))
    own = own[np.lexsort((lo[own], row[own]))]
    begin = np.ones(len(own), bool)
    begin[1:] = (row[own[1:]] != row[own[:-1]]) | (lo[own[1:]] > hi[own[:-1]] + 1)
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(own))[: len(starts)] - 1
    which = np.concatenate([row[first], row[own[starts]]])
    none = np.concatenate([np.zeros(len(first), bool), np.ones(len(starts), bool)])
    with_none = lambda x: pa.array(np.concatenate([x[first].view(np.int64), np.zeros(len(starts), np.int64)]), mask=none)
    signs = np.ascontiguousarray(np.stack([s[first], z[first]], axis=1)).tobytes()
    sig = pa.array([*(signs[k : k + 16] for k in range(0, len(signs), 16)), *[None] * len(starts)], pa.binary())
    plain = lambda x, y: pa.array(np.concatenate([x, y]), pa.int64())
    columns = [with_none(g), sig, plain(times, np.zeros(len(starts), np.int64)), with_none(at), plain(lo[first], lo[own[starts]]), plain(hi[first], hi[own[ends]])]
    which = pa.array(which)
    return pa.RecordBatch.from_arrays([b.column(0).take(which), b.column(2).take(which), *columns], names=["id", "h", "g", "sig", "n", "at", "lo", "hi"])


def _run_batch(g, sig, base, run) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(sig, pa.binary()), pa.array(base, pa.int64()), pa.array(run, pa.binary())], names=["g", "sig", "base", "run"])


def _context_rows(b: pa.RecordBatch, kind: Kind) -> pa.RecordBatch:
    """The symbols of each wanted run; base: its first start relative to the anchor."""
    out: list[list] = [[], [], [], []]
    for text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
        raw = kind.raw((text or "").encode())
        for w in wanted:
            for o, v in zip(out, (w["g"], w["sig"], w["lo"] - w["at"], raw[w["lo"] : w["hi"] + kind.length].tobytes()), strict=True):
                o.append(v)
    return _run_batch(*out)


_HALF = "pg long, psig binary, " + _RUN + ", first long, last long"


def _halves(b: pa.RecordBatch, kind: Kind) -> pa.RecordBatch:
    """Runs whose strings start at offsets from first to last, cut at the middle offset.

    A half's key is the hash of its core: the symbols that every string which starts at any of
    its offsets has. Each run that has a string in the half has the whole core.
    """
    out: list[list] = [[] for _ in range(8)]
    for g, sig, base, run, first, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
        middle, raw = (first + last) // 2, kind.of_run(run)
        n, h = len(raw) - kind.length + 1, _Hashes(kind.values(raw))
        for a, z in ((first, middle), (middle + 1, last)):
            lo, hi = max(a, base), min(z, base + n - 1)
            if lo <= hi:
                core = int(h.of(np.array([z - base]), a + kind.length - z)[0])
                part = raw[lo - base : hi - base + kind.length].tobytes()
                key = xxhash.xxh3_64_intdigest(f"{g} {core} {a} {z}") - (1 << 63)
                for o, v in zip(out, (g, sig, key, signed(part, lo), lo, part, a, z), strict=True):
                    o.append(v)
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names=["pg", "psig", "g", "sig", "base", "run", "first", "last"])


def _indexed(batches, kind: Kind):
    """Adds runs to an index, batch by batch, and yields (g, sig, offs) of strings that repeat.

    Runs come sorted by anchor; an index holds those of whole anchors, of about TASK_STRINGS strings.
    """
    held: list[tuple] = []
    strings = 0
    for b in batches:
        for g, sig, base, run in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if strings >= TASK_STRINGS and g != held[-1][0]:
                yield from _of_index(held, kind)
                held, strings = [], 0
            held.append((g, sig, base, run))
            strings += len(run) // kind.width - kind.length + 1
    if held:
        yield from _of_index(held, kind)


def _of_index(held: list[tuple], kind: Kind):
    """Strings whose hash occurs once can't repeat and aren't indexed; what decides about the others is their symbols."""
    counts = np.array([len(r[3]) // kind.width - kind.length + 1 for r in held], np.int64)
    hashes = [_Hashes(kind.values(kind.of_run(r[3]))).of(np.arange(n), kind.length) for r, n in zip(held, counts.tolist(), strict=True)]
    _, where, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    chosen = np.flatnonzero(times[where] > 1)  # numbers of strings over all runs
    first = np.cumsum(counts) - counts
    owner = np.searchsorted(first, chosen, "right") - 1
    index, hits = LogSuffixIndex(kind.length * kind.width), [np.zeros(0, np.int64)]
    for lo in range(0, len(chosen), BATCH_STRINGS):
        names, of = chosen[lo : lo + BATCH_STRINGS], owner[lo : lo + BATCH_STRINGS]
        used, at = np.unique(of, return_inverse=True)
        text = np.frombuffer(b"".join(held[i][3] for i in used.tolist()), np.uint8)
        size = np.array([len(held[i][3]) for i in used.tolist()], np.int64)
        hits.append(index.add(text, (np.cumsum(size) - size)[at] + kind.width * (names - first[of]), names))
    names = np.unique(np.concatenate(hits))
    if not len(names):
        return
    of = np.searchsorted(first, names, "right") - 1
    begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    out: list[list] = [[], [], []]
    for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(of)], strict=True):
        g, sig, base, _ = held[of[i]]
        for o, v in zip(out, (g, sig, (base + names[i:j] - first[of[i]]).tolist()), strict=True):
            o.append(v)
    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.list_(pa.int64()))], names=["g", "sig", "offs"])


def _merged_runs(lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    """Starts and ends (rows of two) of the stretches that strings starting from lo to hi cover, in order."""
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order]) + length
    new = np.flatnonzero(np.concatenate([[True], lo[1:] > reach[:-1]])[: len(lo)])
    return np.stack([lo[new], reach[np.append(new[1:], len(lo)) - 1]], axis=1) if len(lo) else np.zeros((0, 2), np.int64)


def _span_lists(lists: pa.ListArray, kind: Kind) -> list[np.ndarray]:
    """For each list of (lo, hi), null ones too, the stretches covered."""
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
    flat = lists.flatten()
    lo, hi = flat.field(0).to_numpy(), flat.field(1).to_numpy()
    return [_merged_runs(lo[a:z], hi[a:z], kind.length) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _as_lists(spans: list[np.ndarray]) -> pa.ListArray:
    both = np.concatenate(spans) if spans else np.zeros((0, 2), np.int64)
    values = pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in spans])]).astype(np.int32)), values)


def _kept_rows(b: pa.RecordBatch, kind: Kind, names: list[str], words: Kind | None = None) -> pa.RecordBatch:
    n_bytes, removed, kept, spans = [], [], [], _span_lists(b.column(2), kind)
    for text, own in zip(b.column(1).to_pylist(), spans, strict=True):
        data = (text or "").encode()
        cuts = [0, *own.ravel().tolist(), len(data)]
        rest = b"".join(data[a:z] for a, z in zip(cuts[::2], cuts[1::2], strict=True)) if len(cuts) > 2 else data
        n_bytes.append(len(data))
        removed.append(len(data) - len(rest))
        kept.append(rest)
    said = [_as_lists(_span_lists(b.column(3), words))] if words else []
    return pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), _as_lists(spans), pa.array(kept, pa.binary()), *said], names=names)


#: Runs of consecutive numbers in the sorted array offs.
_CONSECUTIVE = (
    "aggregate(offs, cast(array() as array<struct<lo:bigint,hi:bigint>>), (a, o) -> if(size(a) > 0 and a[size(a) - 1].hi + 1 = o, "
    "concat(slice(a, 1, size(a) - 1), array(named_struct('lo', a[size(a) - 1].lo, 'hi', o))), concat(a, array(named_struct('lo', o, 'hi', o)))))"
)


def _decided(runs: DataFrame, kind: Kind) -> DataFrame:
    """g, sig and runs: the offsets (from lo to hi, relative to the anchor) of strings that repeat.

    runs: one row for each signature of anchors that have several: _RUN, first and last.
    """
    spark = runs.sparkSession
    crowded = stored(runs.groupBy("g").agg(F.count("*").alias("m")).where(F.col("m") > CROWD).select("g"), "crowded")
    crowds = broadcast_if_small(crowded, BROADCAST_ROWS)
    few = runs.join(crowds, "g", "left_anti")
    strings = few.agg(F.sum(F.expr(kind.strings))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-int(strings) // TASK_STRINGS))
    dealt = bounded_batches(few.select("g", "sig", "base", "run").repartition(parts, "g").sortWithinPartitions("g"))
    found = dealt.mapInArrow(lambda it: _indexed(it, kind), "g long, sig binary, offs array<long>").select("g", "sig", F.expr(_CONSECUTIVE).alias("runs"))
    if crowded.isEmpty():
        return found
    found = stored(found, "indexed")
    rows = runs.join(crowds, "g", "left_semi").select("g", "sig", "base", "run", "first", "last")
    halves = stored(map_batches(rows, lambda b: _halves(b, kind), _HALF), "halves")
    cores = stored(halves.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "cores")
    halves_ = stored(halves.join(broadcast_if_small(cores, BROADCAST_ROWS), "g", "left_semi"), "halves")
    drop(halves, cores)
    signs = stored(halves_.groupBy("g", "sig").agg(F.count("*").alias("n")), "signatures")
    twice = signs.where("n > 1").select("g", "sig").withColumn("full", F.lit(True))
    several = stored(signs.groupBy("g").agg(F.count("*").alias("m")).where("m > 1").select("g"), "several")
    again = stored(halves_.join(broadcast_if_small(several, BROADCAST_ROWS), "g", "left_semi").dropDuplicates(["g", "sig"]).select("g", "sig", "base", "run", "first", "last"), "runs")
    below = stored(_decided(again, kind), "decided")
    told = twice.join(below, ["g", "sig"], "full")
    whole = F.expr(f"array(named_struct('lo', base, 'hi', base + {kind.strings} - 1))")
    up = halves_.join(told, ["g", "sig"]).select(F.col("pg").alias("g"), F.col("psig").alias("sig"), F.when(F.col("full"), whole).otherwise(F.col("runs")).alias("runs"))
    up = stored(up.groupBy("g", "sig").agg(F.flatten(F.collect_list("runs")).alias("runs")), "decided")  # two halves at most
    drop(crowded, halves_, signs, several, again, below)
    return found.unionByName(up)


def _texts(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and h: which document a row is of, though ids be null or repeated."""
    text = F.col(text_col).cast("string")
    return documents.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"))


def _anchored(docs: DataFrame, kind: Kind) -> DataFrame:
    return map_batches(docs, lambda b: _anchor_rows(b, kind), _ANCHORS.format(docs.schema["id"].dataType.simpleString()))


def _gone(every: DataFrame, docs: DataFrame, kind: Kind) -> DataFrame:
    """wid, wh and gone: the (lo, hi) of starts of strings that repeat, of each document that has any. Stored.

    every: stored anchors of all documents that may match; docs: their texts.
    """
    # stored, so that its join has a shuffle on both sides and a much-used anchor can be split
    twice = stored(every.where("g is not null").groupBy("g").agg(F.sum("n").alias("n")).where("n > 1").select("g"), "twice")
    held = stored(every.join(broadcast_if_small(twice, BROADCAST_ROWS), "g", "left_semi"), "anchors")
    drop(twice)
    signs = stored(held.groupBy("g", "sig").agg(F.sum("n").alias("n"), F.min(F.struct("id", "h", "at", "lo", "hi")).alias("one")), "signatures")
    several = stored(signs.groupBy("g").agg(F.count("*").alias("m")).where("m > 1").select("g"), "several")
    wanted = signs.join(broadcast_if_small(several, BROADCAST_ROWS), "g").select("g", "sig", "one.*")
    lists = wanted.groupBy(F.col("id").alias("wid"), F.col("h").alias("wh")).agg(F.collect_list(F.struct("g", "sig", "at", "lo", "hi")).alias("wanted"))
    found = docs.join(lists, F.col("id").eqNullSafe(F.col("wid")) & (F.col("h") == F.col("wh")))
    runs = stored(map_batches(found.select("text", "wanted"), lambda b: _context_rows(b, kind), _RUN).dropDuplicates(["g", "sig"]).selectExpr("*", f"{kind.gram - kind.length}L as first", "0L as last"), "runs")
    told = signs.select("g", "sig", (F.col("n") > 1).alias("full")).join(_decided(runs, kind), ["g", "sig"], "left").where("full or runs is not null")
    told = stored(told, "repeats")
    own = F.expr("if(full, array(named_struct('lo', lo, 'hi', hi)), transform(runs, r -> named_struct('lo', at + r.lo, 'hi', at + r.hi)))")
    spread = held.where("n = 1").join(broadcast_if_small(told, BROADCAST_ROWS // 4), ["g", "sig"]).select("id", "h", F.explode(own).alias("r")).select("id", "h", "r.lo", "r.hi")
    spread = spread.union(every.where("g is null").select("id", "h", "lo", "hi")).groupBy("id", "h", "lo").agg(F.max("hi").alias("hi"))
    gone = stored(spread.groupBy(F.col("id").alias("wid"), F.col("h").alias("wh")).agg(F.collect_list(F.struct("lo", "hi")).alias("gone")), "gone")
    drop(held, signs, several, runs, told)
    return gone


def _with_gone(docs: DataFrame, gone: DataFrame) -> DataFrame:
    return docs.join(gone, F.col("id").eqNullSafe(F.col("wid")) & (F.col("h") == F.col("wh")), "left")


_SPANS = "array<struct<start:long,end:long>>"


def _kept(docs: DataFrame, gone: DataFrame, kind: Kind, id_col: str, words: Kind | None = None) -> DataFrame:
    """words: gone has a column said too, which becomes passages."""
    names = [id_col, "n_bytes", "n_removed", "spans", "kept", *(["passages"] if words else [])]
    out = map_batches(_with_gone(docs, gone).select("id", "text", "gone", *(["said"] if words else [])), lambda b: _kept_rows(b, kind, names, words), f"`{id_col}` {docs.schema['id'].dataType.simpleString()}, n_bytes long, n_removed long, spans {_SPANS}, kept binary" + (f", passages {_SPANS}" if words else ""))
    out._reads = [gone]
    return out


@scratched
def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """id_col, n_bytes, n_removed, spans (removed runs: array of (start, end)) and kept (the remaining bytes).

    Null texts are empty; texts shorter than `length` lose nothing. Rows with equal texts
    repeat each other and lose everything if they are long enough, rows with equal or null
    ids too: every row is judged by its own text. Other columns are not read.
    """
    kind, docs = Kind(False, length, gram), _texts(documents, id_col, text_col)
    return _kept(docs, _gone(stored(_anchored(docs, kind), "anchors"), docs, kind), kind, id_col)


@scratched
def word_passages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE, gram: int = PASSAGE_GRAM) -> DataFrame:
    """id_col and passages: array of (start, end) of words in passages of so many words that start anywhere else too.

    White space between words doesn't count. Words are compared by two remainders of 31 bits; other
    rows are treated as by `remove_repeats`. Nothing is removed.
    """
    kind, docs = Kind(True, passage, gram), _texts(documents, id_col, text_col)
    gone = _gone(stored(_anchored(docs, kind), "anchors"), docs, kind)
    told = lambda b: pa.RecordBatch.from_arrays([b.column(0), _as_lists(_span_lists(b.column(1), kind))], names=[id_col, "passages"])
    out = map_batches(_with_gone(docs.select("id", "h"), gone).select("id", "gone"), told, f"`{id_col}` {docs.schema['id'].dataType.simpleString()}, passages {_SPANS}")
    out._reads = [gone]
    return out


@scratched
def repeats_and_passages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, passage: int = PASSAGE, passage_gram: int = PASSAGE_GRAM) -> DataFrame:
    """The columns of `remove_repeats`, then passages as `word_passages` has them; texts meet what was found once."""
    kind, words, docs = Kind(False, length, gram), Kind(True, passage, passage_gram), _texts(documents, id_col, text_col)
    gone, said = (_gone(stored(_anchored(docs, k), "anchors"), docs, k) for k in (kind, words))
    none = F.lit(None).cast(gone.schema["gone"].dataType)
    both = gone.withColumn("said", none).unionByName(said.select("wid", "wh", none.alias("gone"), F.col("gone").alias("said")))
    both = stored(both.groupBy("wid", "wh").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("gone", "said")]), "gone")
    return _kept(docs, both, kind, id_col, words)


@dataclass(frozen=True)
class Level:
    """Documents of earlier batches: id, text and h, and their anchors, sorted by g."""

    docs: DataFrame
    anchors: DataFrame
    rows: int


@dataclass(frozen=True)
class Corpus:
    """Levels from the largest to the smallest."""

    levels: tuple[Level, ...] = ()

    @property
    def _reads(self) -> list[DataFrame]:
        return [t for level in self.levels for t in (level.docs, level.anchors)]


@scratched
def add_batch(corpus: Corpus, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame, Corpus]:
    """What `remove_repeats` gives for the new documents beside all earlier ones; id_col and spans of
    earlier documents that repeat in the new ones (of strings whose anchors they share); the corpus with them.

    Levels are stored tables; those that have been merged into others are deleted, so a corpus is of
    no use once another batch has been added to it. An id may come again: rows are told apart by texts.
    """
    kind = Kind(False, length, gram)
    docs = stored(_texts(documents, id_col, text_col), "texts")
    new = stored(_anchored(docs, kind).repartitionByRange("g").sortWithinPartitions("g"), "anchors")
    met = broadcast_if_small(stored(new.where("g is not null").select("g").distinct(), "met"), BROADCAST_ROWS)
    every, texts = new, docs
    for level in corpus.levels:
        every, texts = every.union(level.anchors.join(met, "g", "left_semi").select(*new.columns)), texts.union(level.docs)
    gone = _gone(every, texts, kind)
    found = _kept(docs, gone, kind, id_col)
    kept = stored(found, "kept")
    older, earlier = None, None
    for level in corpus.levels:
        earlier = level.docs.select("id", "h") if earlier is None else earlier.union(level.docs.select("id", "h"))
    told = lambda b: pa.RecordBatch.from_arrays([b.column(0), _as_lists(_span_lists(b.column(1), kind))], names=[id_col, "spans"])
    earlier = docs.select("id", "h").limit(0) if earlier is None else earlier
    older = stored(map_batches(_with_gone(earlier, gone).where("gone is not null").select("id", "gone"), told, f"`{id_col}` {docs.schema['id'].dataType.simpleString()}, spans {_SPANS}"), "older")
    levels, last = list(corpus.levels), Level(docs, new, docs.count())
    while levels and levels[-1].rows < 2 * last.rows:
        under = levels.pop()
        both = Level(stored(under.docs.union(last.docs), "texts"), stored(under.anchors.union(last.anchors).repartitionByRange("g").sortWithinPartitions("g"), "anchors"), under.rows + last.rows)
        drop(under.docs, under.anchors)
        last = both
    return kept, older, Corpus((*levels, last))
