"""Removal of passages that an earlier document holds, by super-k-mer partitioning.

A window is `WINDOW` consecutive words.  Its minimiser is the least hash of
the `MER` word runs in it; consecutive windows with one minimiser travel as one
packed string to the bucket of that minimiser, so equal windows meet in one
bucket while each word travels about three times instead of thirteen.  A
bucket cuts its strings into windows again, sorts them and finds the least
doc_id of each.  Words covered by a window that a smaller doc_id holds go.

What keeps it even:

* Within a chunk of texts the windows are compared first.  Those that a smaller
  doc_id of the chunk holds are settled there; only the first document's travel.
  Thousands of copies so become one string for each chunk.
* Minimisers that are frequent in a sample rank behind all others; a window
  that has no other goes to the bucket of its own hash.  The sample (at most
  `SAMPLE_DOCS` documents) only evens out the buckets, results don't depend on it.
* The number of buckets follows the number of characters.

Windows are told apart by 128 bits of hash.  Rows with one doc_id are no
duplicates of each other; rows without a doc_id, and null or empty texts, lose
nothing.  Repeated rows get equal results.
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
from sheetloom.llm.words import Words, cut_words, text_words
from sheetloom.session import materialize

WINDOW = 13
MER = 2
BUCKET_CHARS = 4_000_000  # characters of text for each bucket
LEAST_BUCKETS = 64
SAMPLE_DOCS = 4_000
CHUNK = 1 << 21  # bytes of text within which windows are compared first
FLUSH = 24_000_000  # bytes of strings that a task holds before it compresses them by bucket
LATE = np.uint64(1 << 63)

BLOB = "bucket int, texts binary, sizes binary, docs binary"
RUNS = "doc_id bigint, text_key int, start int, n int"
_ROW = np.dtype([("doc", "<i8"), ("key", "<i4"), ("at", "<i4"), ("n", "<i4")])


def _runs(doc: np.ndarray, key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Windows at consecutive places of one text as (doc, key, at, n); the same place may come twice."""
    if not len(at):
        return np.empty(0, _ROW)
    order = np.lexsort((at, key, doc))
    doc, key, at = doc[order], key[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (at[1:] > at[:-1] + 1)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(at)) - 1
    out = np.empty(len(heads), _ROW)
    out["doc"], out["key"], out["at"], out["n"] = doc[heads], key[heads], at[heads], at[tails] - at[heads] + 1
    return out


def _later(h: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which windows a smaller doc_id among these holds too."""
    if not len(h):
        return np.zeros(0, bool)
    order = np.argsort(h, kind="stable")
    sorted_h, sorted_h2 = h[order], h2[order]
    new = np.ones(len(h), bool)
    new[1:] = sorted_h[1:] != sorted_h[:-1]
    if np.any(~new[1:] & (sorted_h2[1:] != sorted_h2[:-1])):  # two windows share 64 bits
        order = np.lexsort((h2, h))
        sorted_h, sorted_h2 = h[order], h2[order]
        new[1:] = (sorted_h[1:] != sorted_h[:-1]) | (sorted_h2[1:] != sorted_h2[:-1])
    heads = np.flatnonzero(new)
    least = np.minimum.reduceat(doc[order], heads)
    out = np.empty(len(h), bool)
    out[order] = doc[order] > np.repeat(least, np.diff(np.append(heads, len(h))))
    return out


def _minimisers(words: Words, n: int, heavy: np.ndarray) -> np.ndarray:
    """The least word-run hash of each window; the top bit is set where all are heavy."""
    mers, _ = words.windows(MER, seed=2)
    mers = mers >> np.uint64(1)
    if len(heavy):
        found = np.minimum(np.searchsorted(heavy, mers), len(heavy) - 1)
        mers = np.where(heavy[found] == mers, mers | LATE, mers)
    span = WINDOW - MER + 1  # runs in a window
    least, width = mers, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    extra = span - width
    if extra:
        least = np.minimum(least[:-extra], least[extra:])
    return least[:n]


class _Buckets:
    """Super-k-mers and settled runs of a task by bucket; they leave compressed, `FLUSH` bytes at a time."""

    def __init__(self, buckets: int, heavy: np.ndarray):
        self.buckets, self.heavy = buckets, heavy
        self.clear()

    def clear(self) -> None:
        self.strings: dict[int, list[bytes]] = {}
        self.sizes: dict[int, list[np.ndarray]] = {}
        self.rows: dict[int, list[np.ndarray]] = {}
        self.held = 0

    def add(self, words: Words, doc_id: np.ndarray, key: np.ndarray) -> None:
        h, inside = words.windows(WINDOW)
        h2, _ = words.windows(WINDOW, seed=1)
        place = np.flatnonzero(inside)
        if not len(place):
            return
        doc = doc_id[words.doc[place]]
        settled = _later(h[place], h2[place], doc)
        if settled.any():
            at = place[settled]
            own = words.doc[at]
            runs = _runs(doc[settled], key[own], (at - words.first[own]).astype(np.int64))
            # settled runs go along, dealt evenly behind the buckets
            self.rows.setdefault(self.buckets + int(h[place[0]] % np.uint64(self.buckets)), []).append(runs)
        least = _minimisers(words, len(h), self.heavy)
        at = place[~settled]
        if not len(at):
            return
        rank = least[at]
        alone = rank >= LATE
        rank = np.where(alone, h[at], rank)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (rank[1:] != rank[:-1]) | alone[1:] | (words.doc[at[1:]] != words.doc[at[:-1]])
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(at)) - 1
        bucket = (rank[heads] % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        heads, tails, bucket = heads[order], tails[order], bucket[order]
        first, last = at[heads], at[tails] + WINDOW - 1
        begin, end = words.starts[first], words.ends[last]
        own = words.doc[first]
        entries = np.empty(len(heads), _ROW)
        entries["doc"], entries["key"], entries["at"], entries["n"] = doc_id[own], key[own], first - words.first[own], 0
        flat, sizes = words.data.tobytes(), (end - begin).astype("<i4")
        strings = [flat[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)], strict=True):
            k = int(bucket[a])
            self.strings.setdefault(k, []).append(b"".join(strings[a:b]))
            self.sizes.setdefault(k, []).append(sizes[a:b])
            self.rows.setdefault(k, []).append(entries[a:b])
        self.held += int(sizes.sum())

    def flush(self) -> Iterator[pa.RecordBatch]:
        """Rows of `BLOB`."""
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        out = []
        for k, parts in sorted(self.rows.items()):
            rows = np.concatenate(parts)
            if k >= self.buckets:
                out.append((k, b"", b"", pack(rows.tobytes())))
            else:
                fields = b"".join(rows[c].tobytes() for c in ("doc", "key", "at"))
                out.append((k, pack(b"".join(self.strings[k])), pack(np.concatenate(self.sizes[k]).tobytes()), pack(fields)))
        self.clear()
        if out:
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "texts", "sizes", "docs"])


def _settle(bucket: int, table: pa.Table, buckets: int) -> np.ndarray:
    """The runs of windows that a smaller doc_id holds, of one bucket."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    if bucket >= buckets:
        return np.concatenate([np.frombuffer(unpack(x.as_py()), _ROW) for x in table["docs"]])
    parts: list[tuple] = []
    for texts, sizes, docs in zip(table["texts"], table["sizes"], table["docs"], strict=True):
        size = np.frombuffer(unpack(sizes.as_py()), "<i4").astype(np.int64)
        n, packed = len(size), unpack(docs.as_py())
        doc = np.frombuffer(packed, "<i8", n)
        key = np.frombuffer(packed, "<i4", n, 8 * n)
        at = np.frombuffer(packed, "<i4", n, 12 * n)
        words = cut_words(np.frombuffer(unpack(texts.as_py()), np.uint8), np.concatenate([[0], np.cumsum(size)]), 0, False)
        h, inside = words.windows(WINDOW)
        h2, _ = words.windows(WINDOW, seed=1)
        place = np.flatnonzero(inside)
        own = words.doc[place]
        parts.append((h[place], h2[place], doc[own], key[own], (at[own] + place - words.first[own]).astype(np.int64)))
    h, h2, doc, key, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    later = _later(h, h2, doc)
    return _runs(doc[later], key[later], at[later])


def _heavy(docs: DataFrame, n_docs: int, buckets: int) -> np.ndarray:
    """Word runs that are the minimiser of too many super-k-mers of a sample (at most a few hundred)."""
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, math.ceil(n_docs / SAMPLE_DOCS)))) == 0).select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in text_words(batch.column(0)):
                n = len(words.hashes) - WINDOW + 1
                if n > 0:
                    least = _minimisers(words, n, np.zeros(0, np.uint64))
                    ranks, times = np.unique(least[np.append(True, np.diff(least) != 0)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ranks.astype(np.int64)), pa.array(times)], ["rank", "n"])

    counts = sample.mapInArrow(count, "rank bigint, n bigint").groupBy("rank").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "minimisers")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(50, total // (8 * buckets))
    return np.sort(np.array([r[0] for r in counts.where(F.col("n") > least).select("rank").collect()], np.int64)).astype(np.uint64)


def _text_key():
    return F.hash(F.coalesce(F.col("text"), F.lit("")))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """Runs of windows of ``docs (doc_id, text)`` that a smaller doc_id holds: doc_id, text_key, start, n."""
    ready_workers(docs.sparkSession)
    n_docs, chars = docs.agg(F.count("doc_id"), F.sum(F.length("text"))).first()
    buckets = max(LEAST_BUCKETS, math.ceil((chars or 0) / BUCKET_CHARS))
    heavy = docs.sparkSession.sparkContext.broadcast(_heavy(docs, n_docs, buckets))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Buckets(buckets, heavy.value)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            for words in text_words(batch.column(2), chunk=CHUNK):
                part = slice(words.row, words.row + words.n_docs)
                held.add(words, ids[part], keys[part])
                if held.held >= FLUSH:
                    yield from held.flush()
        yield from held.flush()

    def settle(key: tuple, table: pa.Table) -> pa.Table:
        runs = _settle(key[0].as_py(), table, buckets)
        return pa.table({"doc_id": runs["doc"], "text_key": runs["key"], "start": runs["at"], "n": runs["n"]})

    named = docs.where("doc_id IS NOT NULL").select("doc_id", _text_key().alias("text_key"), "text")
    return named.mapInArrow(pack, BLOB).groupBy("bucket").applyInArrow(settle, RUNS)


def _kept(text: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[int, int, bytes]:
    words = text.split()
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + sizes + WINDOW - 1, len(words)), -1)
    gone = np.cumsum(edge[:-1]) > 0
    if gone.any():
        keep = np.flatnonzero(~gone).tolist()
        return len(words), len(words) - len(keep), b" ".join([words[i] for i in keep])
    return len(words), 0, b" ".join(words)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, ``kept`` (the words left, joined by one space) and kept_sha256."""
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    runs = repeated_runs(named).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    runs = materialize(runs, "repeats").select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "runs")

    @F.arrow_udf("struct<n_words:bigint,n_removed:bigint,kept:string,kept_sha256:string>")
    def strip(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, r in zip(texts, found, strict=True):
            spans = r.as_py() or []
            starts = np.array([s["start"] for s in spans], np.int64)
            sizes = np.array([s["n"] for s in spans], np.int64)
            n, removed, kept = _kept((t.as_py() or "").encode(), starts, sizes)
            out.append((n, removed, kept.decode(), hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["n_words", "n_removed", "kept", "kept_sha256"])

    keyed = named.withColumn("text_key", _text_key())
    joined = keyed.join(runs, (F.col("doc_id") == F.col("d")) & (F.col("text_key") == F.col("k")), "left")
    return joined.select("doc_id", strip(F.col("text"), F.col("runs")).alias("s")).select("doc_id", "s.*")
