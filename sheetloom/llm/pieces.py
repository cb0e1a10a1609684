"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs that together are a piece;
the pair with the best score is merged first, the leftmost of equals.  A text
is first cut where no piece can cross, so that most cuts repeat and are
encoded once per worker; new short cuts of a batch go through their agendas
side by side, in numpy.  Every cut that is encoded anew is held against the
sentencepiece library within its Arrow batch; a difference fails the task.
"""

from __future__ import annotations

import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom.llm.batches import ready_workers

SPACE = "\u2581"
CACHED_CUTS = 400_000  # per worker; a full cache is emptied
SHORT = 64  # characters up to which cuts are merged side by side; longer ones have a heap each
NO_RANK = (1 << 31) - 1
_CUTS = re.compile(f"\n[^{SPACE}\n]*|{SPACE}+[^{SPACE}\n]*").findall
NORMAL, UNKNOWN, USER_DEFINED, UNUSED, BYTE = 1, 2, 4, 5, 6


class PieceModel:
    """A merge-type vocabulary and its rules, from the bytes of a model file."""

    def __init__(self, model: bytes, check: bool = True):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("only merge-type vocabularies without text normalisation are supported")
        if proto.trainer_spec.treat_whitespace_as_suffix or not spec.escape_whitespaces or kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("white-space suffixes, user-defined and unused pieces are not supported")
        if not spec.add_dummy_prefix:
            raise ValueError("only vocabularies that put a space before a text are supported")
        self.rank: dict[str, float] = {p.piece: -p.score for p in proto.pieces if p.type == NORMAL}
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        if len(self.bytes) < 256:
            raise ValueError("only vocabularies with a piece for every byte are supported")
        self.end = next(i for i, p in enumerate(proto.pieces) if p.piece == proto.trainer_spec.eos_piece)
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.id if len(p) > 1):
            raise ValueError("only vocabularies whose pieces have spaces in front alone, and no line ends, are supported")
        # what a piece reads as, in UTF-8; of other pieces only the unknown one shows
        surface = [
            p.piece.replace(SPACE, " ").encode() if p.type == NORMAL else bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE
            else proto.trainer_spec.unk_surface.encode() if p.type == UNKNOWN else b""
            for p in proto.pieces
        ]
        self.surface = surface
        self.is_byte = np.array([p.type == BYTE for p in proto.pieces])
        self.leads = np.array([p.type == NORMAL and p.piece[0] == SPACE for p in proto.pieces])
        self.is_normal = np.array([p.type == NORMAL for p in proto.pieces])
        self.surface_at = np.concatenate([[0], np.cumsum([len(x) for x in surface])])
        self.surface_bytes = np.frombuffer(b"".join(surface), np.uint8)
        self.library = SentencePieceProcessor(model_proto=model) if check else None
        self._pair_table()
        self.forget()

    def forget(self) -> None:
        self.cuts = _Numbered()
        self.flat, self.flat_at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    @staticmethod
    def cut(text: str) -> list[str]:
        """Where no piece can cross: before runs of spaces and before line ends.

        A cut stands for itself if it starts with a line end, and otherwise
        for itself after one space more.
        """
        if SPACE not in text:
            plain = text.replace("\n", " \n").split(" ")
            if "" not in plain:
                return plain
        cuts = _CUTS(SPACE + text.replace(" ", SPACE))
        return [c if c[0] == "\n" else c[1:] for c in cuts]

    def _pair_table(self) -> None:
        """All pairs of symbols that together are a piece, in a hash table of numpy arrays.

        A symbol is a piece's id; characters of pieces that are none themselves get numbers behind those.
        """
        symbol = dict(self.id)
        for char in {c for p in self.id for c in p}:
            symbol.setdefault(char, len(self.is_byte) + len(symbol))
        self.of_char = np.full(0x110000, -1, np.int64)
        for text, number in symbol.items():
            if len(text) == 1:
                self.of_char[ord(text)] = number
        order = {score: i for i, score in enumerate(sorted(set(self.rank.values())))}
        rows = [
            ((symbol[p[:k]] << 32) | symbol[p[k:]], order[self.rank[p]], self.id[p])
            for p in self.id
            for k in range(1, len(p))
            if p[:k] in symbol and p[k:] in symbol
        ]
        keys, ranks, ids = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        size = 1 << (4 * len(keys)).bit_length()
        self.slot_mask = size - 1
        self.slot_key, self.slot_rank, self.slot_id = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):  # keys whose slot is taken go one further
            free = self.slot_key[slot[todo]] == -1
            _, one = np.unique(slot[todo[free]], return_index=True)
            put = todo[free][one]
            self.slot_key[slot[put]], self.slot_rank[slot[put]], self.slot_id[slot[put]] = keys[put], ranks[put], ids[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            todo = todo[left[todo]]
            slot[todo] = (slot[todo] + (self.slot_key[slot[todo]] != -1)) & self.slot_mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & self.slot_mask

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (`NO_RANK` if none) and id of the piece that two symbols make."""
        keys = (left << 32) | right
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        found = self.slot_key[slot]
        on = np.flatnonzero((found != keys) & (found != -1))
        while len(on):
            slot[on] = (slot[on] + 1) & self.slot_mask
            found[on] = self.slot_key[slot[on]]
            on = on[(found[on] != keys[on]) & (found[on] != -1)]
        hit = found == keys
        return np.where(hit, self.slot_rank[slot], NO_RANK), self.slot_id[slot]

    def merge_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of many texts, and how many each has; characters that are no piece as -1 - code point.

        Each round takes the best pair of every text's agenda, so that texts go on side by side.
        """
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        symbol = self.of_char[points]
        symbol = np.where(symbol < 0, -1 - points, symbol)
        sizes = np.array([len(t) for t in texts], np.int64)
        text = np.arange(len(texts))[sizes > 0]
        left = sizes[text]
        last = np.zeros(len(symbol), bool)
        last[np.cumsum(left) - 1] = True
        rank, made = np.full(len(symbol), NO_RANK), np.zeros(len(symbol), np.int64)
        at = np.flatnonzero(~last)
        rank[at], made[at] = self._pairs(symbol[at], symbol[at + 1])
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(text):
            heads = np.cumsum(left) - left
            best = np.minimum.reduceat((rank << 32) | np.arange(len(rank)), heads)
            live = best >> 32 < NO_RANK
            if not live.all():
                rows = np.repeat(live, left)
                done.append((text[~live], left[~live], symbol[~rows]))
                # where a symbol will stand when the finished texts are gone
                moved = np.cumsum(rows) - 1
                symbol, rank, made, last = symbol[rows], rank[rows], made[rows], last[rows]
                text, left, best = text[live], left[live], moved[best[live] & 0xFFFFFFFF]
                if not len(text):
                    break
                heads = np.cumsum(left) - left
            else:
                best &= 0xFFFFFFFF
            symbol[best] = made[best]
            last[best] |= last[best + 1]
            keep = np.ones(len(symbol), bool)
            keep[best + 1] = False
            symbol, rank, made, last = symbol[keep], rank[keep], made[keep], last[keep]
            order = np.arange(len(best))  # one symbol less for each text before
            best, heads, left = best - order, heads - order, left - 1
            ends = last[best]
            rank[best[ends]] = NO_RANK
            at = np.concatenate([best[~ends], best[best > heads] - 1])
            rank[at], made[at] = self._pairs(symbol[at], symbol[at + 1])
        if not done:
            return np.zeros(0, np.int64), sizes
        who, many, what = (np.concatenate(x) for x in zip(*done, strict=True))
        out = np.zeros(len(texts), np.int64)
        out[who] = many
        start = np.zeros(len(texts), np.int64)
        start[who] = np.cumsum(many) - many
        return _gather(what, start, out), out

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts (spaces escaped) and how many each has; what is no piece becomes its bytes."""
        symbols, sizes = self.merge_many(texts)
        odd = np.flatnonzero((symbols < 0) | (symbols >= len(self.is_byte)))
        if not len(odd):
            return symbols, sizes
        names = {int(n): chr(c) for c in np.flatnonzero(self.of_char >= len(self.is_byte)) for n in [self.of_char[c]]}
        spelled = {s: [self.bytes[b] for b in (chr(-1 - s) if s < 0 else names[s]).encode()] for s in set(symbols[odd].tolist())}
        extra = np.ones(len(symbols), np.int64)
        extra[odd] = [len(spelled[s]) for s in symbols[odd].tolist()]
        out = np.repeat(symbols, extra)
        starts = np.cumsum(extra) - extra
        flat = np.array([b for s in symbols[odd].tolist() for b in spelled[s]], np.int64)
        out[_gather(np.arange(len(out)), starts[odd], extra[odd])] = flat
        ends = np.concatenate([[0], np.cumsum(extra)])[np.concatenate([[0], np.cumsum(sizes)])]
        return out, np.diff(ends)

    def merge(self, text: str) -> list[str]:
        """The symbols left of one text when no adjacent pair is a piece any more."""
        return self._merge_long(text)

    def _merge_long(self, text: str) -> list[str]:
        """The agenda as a heap over linked symbols; entries of symbols merged meanwhile are passed over."""
        rank = self.rank
        symbols: list[str | None] = list(text)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(rank[text[i : i + 2]], i, text[i : i + 2]) for i in range(n - 1) if text[i : i + 2] in rank]
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            left = symbols[i]
            if left is None or (j := after[i]) >= n or len(left) + len(symbols[j]) != len(pair):
                continue
            symbols[i], symbols[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                both = pair + symbols[k]
                if both in rank:
                    heapq.heappush(agenda, (rank[both], i, both))
            if (h := before[i]) >= 0:
                both = symbols[h] + pair
                if both in rank:
                    heapq.heappush(agenda, (rank[both], h, both))
        return [s for s in symbols if s is not None]

    def _ids(self, text: str) -> list[int]:
        own = self.id
        return [i for symbol in self.merge(text) for i in ([own[symbol]] if symbol in own else [self.bytes[b] for b in symbol.encode()])]

    def _learn(self, cuts: list[str]) -> None:
        """Ids of new cuts, held against the library: behind a line end, where nothing joins them to what precedes."""
        texts = [cut if cut[:1] == "\n" else SPACE + cut for cut in cuts]
        ids, sizes = self.ids_of([t if len(t) <= SHORT else "" for t in texts])
        if max(map(len, texts)) > SHORT:
            rows = np.split(ids, np.cumsum(sizes)[:-1])
            rows = [np.array(self._ids(t), np.int64) if len(t) > SHORT else row for t, row in zip(texts, rows, strict=True)]
            ids, sizes = np.concatenate(rows), np.array([len(r) for r in rows], np.int64)
        if self.library is not None:
            shown = ["\n" + t.replace(SPACE, " ") for t in texts]
            lead = len(self.library.encode("\n"))
            theirs = self.library.encode(shown, num_threads=1)
            if [i for row in theirs for i in row[lead:]] != ids.tolist() or [len(row) - lead for row in theirs] != sizes.tolist():
                raise RuntimeError("an encoding differs from the library's")
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
        self.flat_at = np.concatenate([self.flat_at, self.flat_at[-1] + np.cumsum(sizes)])

    def encode_batch(self, texts: list[str], end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offset of each text in it."""
        if len(self.cuts) > CACHED_CUTS:
            self.forget()
        rows = [self.cut(text) if text else [] for text in texts]
        n_cuts = np.array([len(row) for row in rows], np.int64)
        codes = np.fromiter(map(self.cuts.__getitem__, chain.from_iterable(rows)), np.int64)
        del rows
        if self.cuts.new:
            self._learn(self.cuts.new)
            self.cuts.new = []
        sizes = self.flat_at[codes + 1] - self.flat_at[codes]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(n_cuts)]).astype(np.int64)]
        ids = _gather(self.flat, self.flat_at[codes], sizes)
        offsets = ends + np.arange(len(texts) + 1) * end
        if not end:
            return ids, offsets
        out = np.full(len(ids) + len(texts), self.end, np.int32)
        keep = np.ones(len(out), bool)
        keep[offsets[1:] - 1] = False
        out[keep] = ids
        return out, offsets

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of many lists of ids."""
        sizes = (self.surface_at[1:] - self.surface_at[:-1])[ids]
        at = np.concatenate([[0], np.cumsum(sizes)])[offsets]
        buffer = _gather(self.surface_bytes, self.surface_at[ids], sizes).tobytes()
        out = []
        for i in range(len(offsets) - 1):
            a, b = offsets[i], offsets[i + 1]
            if a < b and self.is_normal[ids[a]]:
                try:
                    out.append(buffer[at[i] + bool(self.leads[ids[a]]) : at[i + 1]].decode())
                    continue
                except UnicodeDecodeError:
                    pass
            out.append(self.decode(ids[a:b].tolist()))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes are put together as UTF-8, control pieces are empty, the dummy prefix goes.

        Each byte that is not part of a valid character becomes U+FFFD.
        """
        out: list[str] = []
        run = bytearray()
        first = True
        for i in ids:
            s = self.surface[i]
            if self.is_byte[i]:
                run += s
                first = False
                continue
            if run:
                out.append(_characters(bytes(run)))
                run.clear()
            if first and s:
                first = False
                if self.leads[i]:
                    s = s[1:]
            out.append(s.decode())
        if run:
            out.append(_characters(bytes(run)))
        return "".join(out)


class _Numbered(dict):
    """Numbers cuts in the order of their first sight; ``new`` has those not yet encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, cut: str) -> int:
        self[cut] = number = len(self)
        self.new.append(cut)
        return number


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``flat[start:start + size]`` of all, one after another."""
    total = int(sizes.sum())
    at = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - at, sizes) + np.arange(total)]


def _characters(run: bytes) -> str:
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for size in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("\ufffd")
                at += 1
        return "".join(out)


_models: dict[tuple[int, bool], PieceModel] = {}


def _model(data: bytes, check: bool) -> PieceModel:
    """One model, and so one cache, for each worker process."""
    key = (hash(data), check)
    if key not in _models:
        _models[key] = PieceModel(data, check)
    return _models[key]


def read_model(path: str) -> bytes:
    """The model file, read once on the driver (half a megabyte); tasks get it by broadcast."""
    with open(path, "rb") as f:
        return f.read()


SLICE = 1 << 20  # characters encoded at once, ids decoded at once


def _encode(own: PieceModel, texts: pa.Array, end: bool) -> tuple[np.ndarray, np.ndarray]:
    values, sizes = [], [np.zeros(1, np.int64)]
    part: list[str] = []
    held = 0

    def flush() -> None:
        ids, offsets = own.encode_batch(part, end)
        values.append(ids)
        sizes.append(np.diff(offsets))

    for value in texts:
        part.append(value.as_py() or "")
        held += len(part[-1])
        if held >= SLICE:
            flush()
            part, held = [], 0
    flush()
    return np.concatenate(values), np.cumsum(np.concatenate(sizes))


def _decode(own: PieceModel, ids: np.ndarray, at: np.ndarray) -> list[str]:
    whole: list[str] = []
    step = 0
    for k in range(1, len(at)):
        if at[k] - at[step] >= SLICE or k == len(at) - 1:
            whole += own.decode_batch(ids[at[step] : at[k]], at[step : k + 1] - at[step])
            step = k
    return whole


def _lists(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))


def encode_column(docs: DataFrame, text: Column, model: bytes, end: bool = True, check: bool = True) -> Column:
    """Token ids of a text as ``array<int>``; a null text counts as empty."""
    ready_workers(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<int>")
    def encoded(texts: pa.Array) -> pa.Array:
        return _lists(*_encode(_model(data.value, check), texts, end))

    return encoded(text)


def decode_column(docs: DataFrame, ids: Column, model: bytes) -> Column:
    """The text of token ids; null for null."""
    ready_workers(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def decoded(lists: pa.Array) -> pa.Array:
        whole = _decode(_model(data.value, True), lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy())
        return pa.array([None if null else t for t, null in zip(whole, lists.is_null().to_pylist(), strict=True)], pa.string())

    return decoded(ids)


def coded_column(docs: DataFrame, text: Column, model: bytes, end: bool = True, check: bool = True) -> Column:
    """``struct<ids, decoded>``: the token ids of a text and the text of those ids, in one pass.

    Chained columns would encode twice, once for the ids and once for their text.
    """
    ready_workers(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def coded(texts: pa.Array) -> pa.Array:
        own = _model(data.value, check)
        ids, at = _encode(own, texts, end)
        return pa.StructArray.from_arrays([_lists(ids, at), pa.array(_decode(own, ids, at), pa.string())], ["ids", "decoded"])

    return coded(text)


def encode_documents(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text", check: bool = True) -> DataFrame:
    """Per row: doc_id, ``ids`` (an end id last) and ``decoded``, their text."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return named.select("doc_id", coded_column(docs, F.col("text"), model, check=check).alias("c")).select("doc_id", "c.ids", "c.decoded")


def token_report(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, number of ids, and digests of the ids and of the text they decode to."""
    coded = encode_documents(docs, model, doc_id, text)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
