"""Removal of lines that an earlier document holds, behind two Bloom filters.

A line's key is the line stripped of white space at both ends, A-Z in lower
case; keys of fewer than `MIN_CHARS` code points never count.  The engine

1. cuts each text into keys.  A task keeps the hashes of keys seen in one of its
   documents and of those seen in more, and sends them to the hash segments
   they are of: 8 bytes for each distinct key of the task;
2. fills, for each segment, a filter of once-seen and one of twice-seen hashes.
   A hash that the first one holds already goes into the second;
3. probes every line against the twice-seen filter.  Only lines found there are
   suspects, and only suspects are shuffled under a 128-bit digest, which
   confirms repeats exactly and finds each key's smallest document;
4. drops confirmed lines from all other documents.

A filter has 16 bits for each line of the input, whatever its size.  While all
segments together stay below `BROADCAST_BYTES` they are broadcast; beyond that
the lines' 32-byte rows meet them by a join on the segment.  The filters decide
how much is shuffled and never the result: a hash seen in two documents is
always found, and false finds fail the confirmation.

Documents are told apart by doc_id: repeated rows of one doc_id are no repeats
of each other and lose the same lines.  Rows without a doc_id lose nothing and
make nothing repeated.  A null or empty text is one empty line.  Ties cannot
arise, as the smallest doc_id is unique.  An empty table gives an empty result.
Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetloom.llm.batches import ready_workers
from sheetloom.session import materialize

MIN_CHARS = 10
SEGMENT_BITS = 20  # a segment's filter has 2^20 bits
SEGMENT_LINES = 1 << 16
LEAST_PARTS = 64  # filters are filled in at least so many groups, where there are so many segments
PART_SEGMENTS = 16  # and in groups of at most so many segments
BROADCAST_BYTES = 16 << 20
FLUSH = 4_000_000  # hashes that a task holds before it sends them off

_SPACE = b" \t\n\x0b\x0c\r"
_MASK = np.uint64((1 << SEGMENT_BITS) - 1)
_SHIFTS = (24, 64 - SEGMENT_BITS)  # where a hash's two places in its segment are


def line_key(line: bytes) -> bytes | None:
    """The key of a line, or None if it is too short to count."""
    key = line.strip(_SPACE).lower()  # bytes.lower() changes A-Z alone
    if len(key) < MIN_CHARS or (len(key) < 4 * MIN_CHARS and len(key.decode()) < MIN_CHARS):
        return None
    return key


def _digests(text: str | None) -> dict[bytes, None]:
    """The distinct digests of a text's keys."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    keys = {k for k in map(line_key, (text or "").encode().split(b"\n")) if k is not None}
    return dict.fromkeys(digest(k) for k in keys)


def _hashes(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8")[::2]


def _combined(once: list[np.ndarray], twice: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in one of the ``once`` lists, and those in two of them or in any of ``twice``."""
    single, times = np.unique(np.concatenate([np.zeros(0, "<i8"), *once]), return_counts=True)
    double = np.union1d(single[times > 1], np.concatenate([np.zeros(0, "<i8"), *twice]))
    return np.setdiff1d(single, double, assume_unique=True), double


def _places(hashes: np.ndarray) -> list[np.ndarray]:
    return [((hashes.view(np.uint64) >> np.uint64(s)) & _MASK).astype(np.int64) for s in _SHIFTS]


def _sent(once: list[np.ndarray], twice: list[np.ndarray], segments: int, each: int) -> pa.RecordBatch:
    """A task's hashes by group of segments."""
    both = _combined(once, twice)
    packed: list[dict[int, bytes]] = []
    for hashes in both:
        part = np.mod(hashes, segments) // each
        order = np.argsort(part, kind="stable")
        part, hashes = part[order], hashes[order]
        heads = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else part
        tails = np.append(heads[1:], len(part))
        packed.append({int(part[a]): hashes[a:b].tobytes() for a, b in zip(heads, tails, strict=False)})
    keys = sorted(packed[0].keys() | packed[1].keys())
    columns = [pa.array(keys, pa.int32()), *(pa.array([p.get(k, b"") for k in keys], pa.binary()) for p in packed)]
    return pa.RecordBatch.from_arrays(columns, ["part", "once", "twice"])


def _twice_seen(table: pa.Table, segments: int, each: int) -> pa.Table:
    """The twice-seen filters of a group of segments, as arrays of 64-bit words."""
    part = table["part"][0].as_py()
    size = 1 << SEGMENT_BITS
    first, second = np.zeros(each * size, bool), np.zeros(each * size, bool)

    def places(hashes: np.ndarray) -> list[np.ndarray]:
        base = (np.mod(hashes, segments) - part * each) * size
        return [base + p for p in _places(hashes)]

    def put(once: list[np.ndarray], twice: list[np.ndarray]) -> None:
        single, double = _combined(once, twice)
        a, b = places(single)
        seen = first[a] & first[b]
        second[a[seen]] = second[b[seen]] = True
        first[a] = first[b] = True
        for p in places(double):
            first[p] = second[p] = True

    once: list[np.ndarray] = []
    twice: list[np.ndarray] = []
    held = 0
    for x, y in zip(table["once"], table["twice"], strict=True):
        once.append(np.frombuffer(x.as_py(), "<i8"))
        twice.append(np.frombuffer(y.as_py(), "<i8"))
        held += len(once[-1]) + len(twice[-1])
        if held >= SEGMENT_LINES:  # many short lists are merged in one go
            put(once, twice)
            once, twice, held = [], [], 0
    put(once, twice)
    words = np.packbits(second.reshape(each, size), axis=1, bitorder="little").view("<i8")
    used = np.flatnonzero(words.any(axis=1))
    offsets = np.arange(len(used) + 1, dtype=np.int32) * words.shape[1]
    bits = pa.ListArray.from_arrays(pa.array(offsets), pa.array(words[used].reshape(-1)))
    return pa.table({"segment": pa.array((used + part * each).astype(np.int64)), "bits": bits})


def twice_seen(docs: DataFrame, segments: int) -> DataFrame:
    """The twice-seen filter of the keys of ``docs (doc_id, text)``: segment, bits (64-bit words)."""
    each = math.ceil(segments / max(LEAST_PARTS, math.ceil(segments / PART_SEGMENTS)))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: list[np.ndarray] = []
        twice: list[np.ndarray] = []
        held = 0
        for batch in batches:
            own = [_hashes(list(_digests(t.as_py()))) for t in batch.column(1)]
            single, double = _combined(own, [])
            once.append(single)
            twice.append(double)
            held += len(single) + len(double)
            if held >= FLUSH:
                yield _sent(once, twice, segments, each)
                once, twice, held = [], [], 0
        yield _sent(once, twice, segments, each)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        return _twice_seen(table, segments, each)

    sent = docs.mapInArrow(fill, "part int, once binary, twice binary")
    return sent.groupBy("part").applyInArrow(merge, "segment long, bits array<bigint>")


def suspected_lines(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``doc_id, digest`` of each key of ``docs (doc_id, text)`` that the twice-seen filter holds, once a row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    n_lines = docs.agg(F.sum(breaks + 1)).first()[0] or 0
    segments = max(1, math.ceil(n_lines / SEGMENT_LINES))
    filters = materialize(twice_seen(docs, segments), "line-filters")
    if segments << SEGMENT_BITS <= 8 * broadcast_bytes:
        filters = F.broadcast(filters)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(_digests(t.as_py())) for t in batch.column(1)]
            flat = [d for own in found for d in own]
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(x) for x in found])
            hashes = _hashes(flat)
            columns = [pa.array(ids, pa.int64()), pa.array(np.mod(hashes, segments)), pa.array(hashes), pa.array(flat, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "at", "hash", "digest"])

    lines = docs.mapInArrow(cut, "doc_id long, at long, hash long, digest binary")

    def held(shift: int):
        place = F.shiftrightunsigned("hash", shift).bitwiseAND(F.lit(int(_MASK)))
        word = F.get("bits", F.shiftright(place, 6).cast("int"))
        bit = F.call_function("shiftright", word, place.bitwiseAND(F.lit(63)).cast("int"))
        return bit.bitwiseAND(F.lit(1)) == 1

    found = lines.join(filters, (F.col("at") == F.col("segment")) & held(_SHIFTS[0]) & held(_SHIFTS[1]))
    return found.select("doc_id", "digest")


def repeated_lines(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document that loses lines: doc_id and the ``digests`` of the keys that a smaller doc_id holds."""
    suspects = materialize(suspected_lines(docs, broadcast_bytes), "line-suspects")
    both = suspects.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    # written, so that both sides of the join come straight from a shuffle and a very common line can be split at run time
    owners = materialize(both.select(F.col("digest").alias("d"), "least"), "line-owners")
    later = suspects.join(owners, (F.col("digest") == F.col("d")) & (F.col("doc_id") > F.col("least")))
    return later.groupBy("doc_id").agg(F.collect_set("digest").alias("digests"))


def _kept(text: str | None, gone: set[bytes]) -> tuple[int, int, str]:
    import xxhash

    lines = (text or "").encode().split(b"\n")
    if not gone:
        return len(lines), 0, text or ""
    kept = []
    for line in lines:
        key = line_key(line)
        if key is None or xxhash.xxh3_128_digest(key) not in gone:
            kept.append(line)
    return len(lines), len(lines) - len(kept), b"\n".join(kept).decode()


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row: doc_id, n_lines (before), n_dropped, ``kept`` (the text left) and kept_sha256."""
    ready_workers(docs.sparkSession)
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    gone = materialize(repeated_lines(named.where("doc_id IS NOT NULL"), broadcast_bytes), "line-repeats")

    @F.arrow_udf("struct<n_lines:bigint,n_dropped:bigint,kept:string,kept_sha256:string>")
    def strip(texts: pa.Array, digests: pa.Array) -> pa.Array:
        out = []
        for t, d in zip(texts, digests, strict=True):
            n, dropped, kept = _kept(t.as_py(), set(d.as_py() or ()))
            out.append((n, dropped, kept, hashlib.sha256(kept.encode()).hexdigest()))
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["n_lines", "n_dropped", "kept", "kept_sha256"]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    gone = gone.select(F.col("doc_id").alias("d"), "digests")
    joined = named.join(gone, F.col("doc_id") == F.col("d"), "left")
    return joined.select("doc_id", strip(F.col("text"), F.col("digests")).alias("s")).select("doc_id", "s.*")
