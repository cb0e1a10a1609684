"""Near-duplicate rows: token-sorted similarity, pairs and groups.

Two rows match when their texts, with the words sorted, reach a similarity of
``200 * LCS / (length + length)`` of at least the threshold (0-100).

How the join stays exact without comparing everything:

1. Equal texts collapse to one representative.
2. Let D be the largest number of insertions and deletions a text of length n
   can be away from a shorter match.  Of ``D // 2 + 1`` disjoint chunks of the
   longer text, at least one then survives with no more than one edit.  So
   that text is indexed under its chunks and their one-letter deletions, and
   the shorter one is looked up under its substrings and theirs.
3. The chunks of a text are free to choose; the rarest ones are taken, by a
   fixed-size frequency sketch, so boilerplate shared by many rows is avoided
   wherever the text has anything else to offer.
4. Where the edits leave no chunk whole (short texts, low thresholds), a text
   is a bag of tokens (letter, how often it came before).  A match has a known
   number of tokens in common, so the rarest few of each side must meet.
5. The index keys go into a filter of bounded size, shipped once; only probing
   keys that it knows are written.
6. Length, position and letter-count bounds are part of the join, so pairs
   that fail them are never emitted; the rest is verified with a bit-parallel
   LCS.

For groups only connectivity matters.  Neighbours in several sorted orders are
linked first (linear work), among them an order by letter counts.  Then only
pairs across different components are looked for, in one of two exact ways:

* Texts of one component that share their length and all counts but those of
  digits form a box; where these are too many, texts that share the sums of eight
  counts each.  Boxes whose lengths and counts rule out a match never meet; the
  texts of the others do, under the same bounds.  This is for large components
  that lie apart, whose keys would meet at every word in common.
* By keys as above, where boxes are too many or rule out too little.  Key groups
  only produce pairs across components, so a dense cluster lists none of its own.

Of the pairs between two components a few are verified first, the rest only if
none of them matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetloom.functions.cells import as_text, strip
from sheetloom.operators.components import connected_components
from sheetloom.rows import ROW_ID, require_columns, require_row_id, text_columns
from sheetloom.session import materialize, ship_package, shuffle_partitions

DEFAULT_THRESHOLD = 87
SKETCH_SIZE = 1 << 18
SKETCH_TEXTS = 1_000_000
BLOCK = 512
SLICE_LETTERS = 50_000
FILTER_BITS = 1 << 20, 1 << 28  # least and most bits of the filter of index keys; 32 MB at most
BITS_PER_KEY = 16
WORD = 64
PAIRS_AT_ONCE = 4_096
TURNS = 4  # orders that start at so many places of a text
FIRST_TRIES = 4  # candidates of two components that are verified before the rest
NEIGHBOURS = 4  # texts before it that a text is held against in the order by letters
NEIGHBOUR_LETTERS = 256  # longer ones only against the last
CLASSES = 64  # of letters, eight to a word
BOX_WORDS = 6  # of the eight; the last two have the digits
BOX_PART = 256  # texts of a box that meet in one go
BOX_DEALS = 32
BANDS = 8  # of lengths, within the longest and the shortest that match
BOX_MEETINGS = 5_000  # a text, and of texts in boxes; beyond that keys are the cheaper way
TEXT_MEETINGS = 100_000
CANDIDATES_A_TEXT = 20
FEW_TEXTS = 10_000  # smaller tables are no reason for keys
SEPARATOR = " | "


# --------------------------------------------------------------------------
# texts
# --------------------------------------------------------------------------


def row_text(df: DataFrame, columns: list[str]) -> Column:
    """The compared text of a row: cells joined, lower case, trimmed."""
    cells = [F.coalesce(as_text(df, c), F.lit("")) for c in columns]
    return strip(F.lower(F.concat_ws(SEPARATOR, *cells)))


def sorted_words(text: Column) -> Column:
    return F.array_join(F.array_sort(F.split(strip(text), r"(?U)\s+")), " ")


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    start, end_a, end_b = 0, len(a), len(b)
    while start < end_a and start < end_b and a[start] == b[start]:
        start += 1
    while end_a > start and end_b > start and a[end_a - 1] == b[end_b - 1]:
        end_a -= 1
        end_b -= 1
    same = start + len(a) - end_a
    a, b = a[start:end_a], b[start:end_b]
    if not a or not b:
        return same
    places: dict[str, int] = {}
    for i, letter in enumerate(a):
        places[letter] = places.get(letter, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for letter in b:
        hit = row & places.get(letter, 0)
        row = ((row + hit) | (row - hit)) & full
    return same + len(a) - row.bit_count()


def lcs_lengths(left: list[str], right: list[str]) -> np.ndarray:
    """LCS lengths of many pairs.

    Pairs whose shorter text fits a 64-bit word are worked on side by side, a
    word each; longer ones one by one, where a step is worth its call.
    """
    found = np.zeros(len(left), np.int64)
    words = []
    for i, (a, b) in enumerate(zip(left, right)):
        if len(a) > len(b):
            a, b = b, a
        if len(a) > WORD:
            found[i] = lcs_length(a, b)
        elif a:
            words.append((len(b), i, a, b))
    words.sort(key=lambda w: w[:2])  # slices of like length need little padding
    at = 0
    while at < len(words):
        _, index, a, b = zip(*words[at : at + PAIRS_AT_ONCE])
        found[list(index)] = _lcs_words(_Texts(list(a)), _Texts(list(b)))
        at += PAIRS_AT_ONCE
    return found


def _lcs_words(a: _Texts, b: _Texts) -> np.ndarray:
    """The same for texts ``a`` of at most 64 letters: the bit-parallel recurrence over all pairs at once."""
    pairs = len(a.length)
    letters, kind = np.unique(a.codes, return_inverse=True)
    # places of each letter of a pair's text; a letter it lacks and the padding have none
    cells, cell = np.unique(a.owner * (len(letters) + 1) + kind, return_inverse=True)
    places = np.zeros(len(cells) + 1, np.uint64)
    np.add.at(places, cell, np.uint64(1) << a.place.astype(np.uint64))
    known = np.minimum(np.searchsorted(letters, b.codes), len(letters) - 1)
    wanted = b.owner * (len(letters) + 1) + np.where(letters[known] == b.codes, known, len(letters))
    slot = np.minimum(np.searchsorted(cells, wanted), len(cells) - 1)
    steps = np.full((int(b.length.max()), pairs), len(cells))
    steps[b.place, b.owner] = np.where(cells[slot] == wanted, slot, len(cells))
    row = np.full(pairs, ~np.uint64(0))
    for step in steps:
        hit = row & places[step]
        row = (row + hit) | (row - hit)
    unused = np.uint64(WORD) - a.length.astype(np.uint64)
    return a.length - np.bitwise_count((row << unused) >> unused).astype(np.int64)


@F.pandas_udf(T.IntegerType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(lcs_lengths(a.tolist(), b.tolist()), dtype="int32")


def similarity(a: Column, b: Column) -> Column:
    """Token-sorted similarity of two texts, 0-100."""
    ship_package()
    x, y = sorted_words(a), sorted_words(b)
    total = F.length(x) + F.length(y)
    return F.when(total == 0, 100.0).otherwise(F.lit(200.0) * lcs(x, y) / total)


# --------------------------------------------------------------------------
# chunks and their keys
# --------------------------------------------------------------------------


@dataclass
class Geometry:
    """Which chunks prove a match at a threshold."""

    threshold: int

    @property
    def widths(self) -> tuple[int, ...]:
        """Chunk lengths to choose from; wide ones are selective, narrow ones leave a choice."""
        widest = min(8, 100 // max(1, 100 - self.threshold) - 1)
        return tuple(w for w in sorted({widest, (2 * widest + 1) // 3, (widest + 1) // 2}) if w >= 2)

    def edits(self, n: int) -> int:
        """Most insertions and deletions between a text of length n and a shorter match."""
        return 2 * n * (100 - self.threshold) // 100

    def chunks(self, n: int) -> int:
        """Disjoint chunks of which one must survive with at most one edit."""
        return self.edits(n) // 2 + 1

    def by_letters(self, n: int) -> bool:
        """Too many edits for any chunk: a match still shares a letter."""
        if not self.widths:
            return True
        least = self.widths[0]
        slack = least * (n // BLOCK + 1) if n > 2 * BLOCK else 0  # long texts choose block by block
        return self.chunks(n) * least + slack > n

    def index_letters(self, n: np.ndarray) -> np.ndarray:
        """Rarest tokens of a text of length n of which one is among those of any match no longer than it."""
        shortest = -(-n * self.threshold // (200 - self.threshold))
        return n + 1 + -(n + shortest) * self.threshold // 200

    def probe_letters(self, n: np.ndarray) -> np.ndarray:
        """The same for matches that are no shorter."""
        return n + 1 + -n * self.threshold // 100

    @cached_property
    def letters_needed(self) -> bool:
        if not self.widths:
            return True
        share = self.widths[0] * ((100 - self.threshold) / 100 + 1 / BLOCK)  # of a very long text
        return share >= 1 or any(self.edits(n) and self.by_letters(n) for n in range(1, 5000))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(codes: np.ndarray, width: int, skip: int | None = None) -> np.ndarray:
    """A hash of the window at every place, one of its letters left out if asked.

    Windows that overrun the end of their text hold no meaning; callers mask them.
    """
    padded = np.concatenate([codes, np.zeros(width, np.uint64)])
    h = np.zeros(len(codes), np.uint64)
    for i in range(width):
        if i != skip:
            h = (h ^ padded[i : i + len(codes)]) * _MIX
            h ^= h >> np.uint64(29)
    return h


def _key(h: np.ndarray, width: int, shortened: bool) -> np.ndarray:
    return (h ^ np.uint64(2 * width + shortened)) * _MIX


def _cells(keys: np.ndarray) -> np.ndarray:
    return ((keys >> np.uint64(20)) % np.uint64(SKETCH_SIZE)).astype(np.int64)


class _Texts:
    """Several texts laid end to end, so that hashing runs over all of them at once."""

    def __init__(self, texts: list[str]) -> None:
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.length = np.array([len(t) for t in texts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(texts)), self.length)
        self.place = np.arange(len(self.codes)) - self.start[self.owner]
        self.room = self.length[self.owner] - self.place

    def letter_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Per text, its letters in 32 classes, as bit sets.

        A class has eight bits, of which as many are set as it has letters, so
        the bits two texts share count their common letters.  Letters that do
        not fit are counted on the side.
        """
        classes = np.where(self.codes - np.uint64(97) < 26, self.codes - np.uint64(97), np.uint64(31))
        digit = self.codes - np.uint64(48) < 10
        classes = np.where(digit, np.uint64(26) + self.codes % np.uint64(5), classes)
        other = self.codes > np.uint64(127)
        classes = np.where(other, self.codes % np.uint64(32), classes).astype(np.int64)
        counts = np.bincount(self.owner * 32 + classes, minlength=32 * len(self.length)).reshape(-1, 32)
        return _unary(counts)

    def class_counts(self) -> np.ndarray:
        """Per text, how often it has each class of letters: a to z, other signs in 28 classes, ten digits."""
        letter, digit = self.codes - np.uint64(97), self.codes - np.uint64(48)
        classes = np.uint64(26) + self.codes % np.uint64(28)
        classes = np.where(letter < 26, letter, np.where(digit < 10, np.uint64(54) + digit, classes)).astype(np.int64)
        return np.bincount(self.owner * CLASSES + classes, minlength=CLASSES * len(self.length)).reshape(-1, CLASSES)

    @cached_property
    def letter_tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys, owners) of every letter with the number of times it came before in its text."""
        order = np.lexsort((self.codes, self.owner))
        codes, owner = self.codes[order], self.owner[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(fresh)
        nth = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        h = (codes * _MIX ^ nth.astype(np.uint64)) * _MIX
        return _key(h ^ (h >> np.uint64(29)), 1, False), owner

    def rarest_letters(self, limits: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, owners, ranks) of the first ``limits`` tokens of every text, in one order for all texts."""
        keys, owner = self.letter_tokens
        order = np.lexsort((keys, sketch[_cells(keys)], owner))
        rank = np.arange(len(order)) - self.start[owner]  # a text has as many tokens as letters
        kept = rank < limits[owner]
        return keys[order][kept], owner[kept], rank[kept]

    def probe_keys(self, g: Geometry) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(width, keys, flat places) of the chunks under which a text looks for longer partners."""
        for w in g.widths:
            forms = [(_gram_hashes(self.codes, w), w, False), (_gram_hashes(self.codes, w - 1), w - 1, True)]
            forms += [(_gram_hashes(self.codes, w + 1, skip=j), w + 1, False) for j in range(1, w)]
            for h, span, shortened in forms:
                at = np.flatnonzero(self.room >= span)
                yield w, _key(h[at], w, shortened), at

    def index_keys(self, g: Geometry, sketch: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(width, keys, flat places) of the chosen chunks of every text."""
        forms, costs = {}, {}
        for w in g.widths:
            keys = [_key(_gram_hashes(self.codes, w), w, False)]
            keys += [_key(_gram_hashes(self.codes, w, skip=j), w, True) for j in range(w)]
            forms[w] = keys
            costs[w] = sum(sketch[_cells(k)] for k in keys).astype(float)
        chosen: dict[int, list[int]] = {w: [] for w in g.widths}
        for start, n in zip(self.start.tolist(), self.length.tolist()):
            if not g.edits(n) or g.by_letters(n):
                continue  # only an equal text could match, or one with the same rare letters
            own = {w: costs[w][start : start + n] for w in g.widths}
            for at, w in rarest_chunks(own, n, g.chunks(n)):
                chosen[w].append(start + at)
        for w, places in chosen.items():
            at = np.array(places, np.int64)
            for keys in forms[w]:
                yield w, keys[at], at


def _unary(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as bits, eight a class, and how many letters did not fit."""
    bits = ((1 << np.minimum(counts, 8)) - 1).astype(np.uint8)
    return np.ascontiguousarray(bits).view(np.int64), np.maximum(counts - 8, 0).sum(axis=1)


def rarest_chunks(cost: dict[int, np.ndarray], n: int, chunks: int) -> list[tuple[int, int]]:
    """``chunks`` disjoint windows ``(start, width)`` with the least total cost.

    ``cost[w][i]`` is the cost of the window of width w at i.
    """
    if n > 2 * BLOCK:  # long texts: every block gives its share
        found, at = [], 0
        while at < n:
            stop = n if n - at < 2 * BLOCK else at + BLOCK
            share = min(-(-chunks * (stop - at) // n), (stop - at) // min(cost))
            part = {w: c[at:stop] for w, c in cost.items()}
            found += [(at + s, w) for s, w in rarest_chunks(part, stop - at, share)]
            at = stop
        return found
    best = np.zeros(n + 1)
    steps = []
    for _ in range(chunks):
        take = np.full(n + 1, np.inf)  # cheapest way whose last window ends exactly here
        width = np.zeros(n + 1, np.int64)
        for w, c in cost.items():
            if w <= n:
                ends = best[: n + 1 - w] + c[: n + 1 - w]
                better = ends < take[w:]
                take[w:][better] = ends[better]
                width[w:][better] = w
        steps.append((take, width))
        best = np.minimum.accumulate(take)
    found, end = [], n
    for take, width in reversed(steps):
        at = int(np.argmin(take[: end + 1]))
        w = int(width[at])
        found.append((at - w, w))
        end = at - w
    return found[::-1]


def _slices(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Cut a batch so that the keys of one slice stay small in memory."""
    size = pdf["s"].str.len().cumsum() // SLICE_LETTERS
    for _, part in pdf[pdf["s"] != ""].groupby(size, sort=False):
        yield part


@F.pandas_udf(T.BinaryType())
def letter_key(text: pd.Series) -> pd.Series:
    """The letter counts of a text, a byte each, digits last."""
    size = text.str.len().cumsum() // SLICE_LETTERS
    found = []
    for _, part in text.groupby(size, sort=False):
        found += [row.tobytes() for row in np.minimum(_Texts(part.tolist()).class_counts(), 255).astype(np.uint8)]
    return pd.Series(found, dtype=object)


def _sketch_batches(threshold: int):
    """How many probing keys fall into each cell of the sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = np.zeros(SKETCH_SIZE, np.int64)
        for pdf in batches:
            for part in _slices(pdf):
                texts, g = _Texts(part["s"].tolist()), Geometry(threshold)
                for _, keys, _ in texts.probe_keys(g):
                    cells += np.bincount(_cells(keys), minlength=SKETCH_SIZE)
                if g.letters_needed:
                    cells += np.bincount(_cells(texts.letter_tokens[0]), minlength=SKETCH_SIZE)
        used = np.flatnonzero(cells)
        yield pd.DataFrame({"cell": used, "n": cells[used]})

    return run


INDEX, PROBE = 0, 1
KEY_SCHEMA = "rep long, component long, n int, role int, k long, p int, w0 long, w1 long, w2 long, w3 long, rest int"


def _key_batches(threshold: int, role: int, sketch, known=None):
    """One row per key of a role: indexing a text, or looking for longer ones.

    ``p`` is the place of a chunk, or -1 and further down the rank of a letter.
    Keys that a filter of the index does not know are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = Geometry(threshold)
        for pdf in batches:
            for part in _slices(pdf):
                texts = _Texts(part["s"].tolist())
                rep, component = part["rep"].to_numpy(), part["component"].to_numpy()
                bags, rest = texts.letter_counts()
                for keys, owner, place in _role_keys(texts, g, role, sketch.value):
                    if known is not None:
                        met = _may_hold(known.value, keys)
                        keys, owner, place = keys[met], owner[met], place[met]
                    yield pd.DataFrame(
                        {
                            "rep": rep[owner],
                            "component": component[owner],
                            "n": texts.length[owner].astype(np.int32),
                            "role": np.full(len(keys), role, np.int32),
                            "k": keys.view(np.int64),
                            "p": place.astype(np.int32),
                            **{f"w{i}": bags[owner, i] for i in range(4)},
                            "rest": rest[owner].astype(np.int32),
                        }
                    )

    return run


def _role_keys(texts: _Texts, g: Geometry, role: int, sketch: np.ndarray):
    """(keys, owners, places) of the chunks and then of the letters."""
    for _, keys, at in texts.index_keys(g, sketch) if role == INDEX else texts.probe_keys(g):
        yield keys, texts.owner[at], texts.place[at]
    if g.letters_needed:
        if role == INDEX:
            wanted = [bool(g.edits(n)) and g.by_letters(n) for n in texts.length.tolist()]
            limits = np.where(wanted, g.index_letters(texts.length), 0)
        else:
            limits = g.probe_letters(texts.length)
        keys, owner, rank = texts.rarest_letters(limits, sketch)
        yield keys, owner, -1 - rank


def _may_hold(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether a filter, as 64-bit words, may hold each key: two bits a key."""
    last = np.uint64(64 * len(words) - 1)
    held = np.ones(len(keys), bool)
    for bit in (keys & last, (keys >> np.uint64(32)) & last):
        held &= (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
    return held


# --------------------------------------------------------------------------
# candidates and verification
# --------------------------------------------------------------------------


def _representatives(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(row id and digest of every row, one written row per distinct text)."""
    text = sorted_words(row_text(df, columns))
    rows = df.select(F.col(ROW_ID), text.alias("s")).withColumn("digest", F.unhex(F.sha2("s", 256)))
    reps = rows.groupBy("digest").agg(
        F.min(ROW_ID).alias("rep"), F.any_value("s").alias("s"), F.count("*").alias("copies")
    )
    return rows.select(ROW_ID, "digest"), materialize(reps, "texts")


def _gram_sketch(reps: DataFrame, threshold: int):
    """Key frequencies in a fixed number of cells, shared with the tasks.

    They only steer which chunks a text is indexed under, so a sample will do.
    """
    share = SKETCH_TEXTS / max(reps.count(), 1)
    texts = reps.select("s")
    cells = (
        (texts.sample(fraction=share, seed=17) if share < 1 else texts)
        .mapInPandas(_sketch_batches(threshold), "cell long, n long")
        .groupBy("cell")
        .agg(F.sum("n").alias("n"))
        .collect()  # at most SKETCH_SIZE rows
    )
    sketch = np.zeros(SKETCH_SIZE, np.int64)
    for row in cells:
        sketch[row["cell"]] = row["n"]
    return reps.sparkSession.sparkContext.broadcast(sketch)


def _key_filter(indexed: DataFrame):
    """A Bloom filter of the index keys, shared with the tasks.

    Its size follows their number up to a fixed bound.  Beyond that it lets more
    probing keys pass, which costs rows and changes no result.
    """
    least, most = FILTER_BITS
    bits = min(max(1 << (BITS_PER_KEY * indexed.count()).bit_length(), least), most)
    place = lambda c: c.bitwiseAND(F.lit(bits - 1))
    found = (
        indexed.select(F.explode(F.array(place(F.col("k")), place(F.shiftrightunsigned("k", 32)))).alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits"))
        .toArrow()  # one row a word of the filter at most
    )
    words = np.zeros(bits // 64, np.uint64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return indexed.sparkSession.sparkContext.broadcast(words)


def _close(threshold: int) -> Column:
    """Length and place bounds between an indexed and a probing text.

    Of letters, the first that two texts share leaves them no more in common
    than comes after it in either.
    """
    total = F.col("na") + F.col("nb")
    least = F.ceil(total * threshold / F.lit(200))  # LCS of a match
    shift = F.col("pb") - F.col("pa")
    after = F.least(F.col("na") + F.col("pa"), F.col("nb") + F.col("pb")) + 1
    near = (shift >= least - F.col("na") - 1) & (shift <= F.col("nb") - least + 1)
    return (
        (F.col("na") >= F.col("nb"))
        & (F.col("nb") * 200 >= total * threshold)
        & ((F.col("na") > F.col("nb")) | (F.col("a") < F.col("b")))
        & F.when(F.col("pa") < 0, after >= least).otherwise(near)
    )


def _enough_letters(threshold: int) -> Column:
    """The letters two texts have in common bound their LCS from above."""
    common = F.least("resta", "restb")
    for w in ("w0", "w1", "w2", "w3"):
        common = common + F.bit_count(F.col(f"{w}a").bitwiseAND(F.col(f"{w}b")))
    return common * 200 >= (F.col("na") + F.col("nb")) * threshold


def _candidates(reps: DataFrame, threshold: int, across_components: bool) -> DataFrame:
    """Distinct candidate pairs ``(a, b)`` of representatives, and their components ``(u, v)``.

    ``reps (rep, s, component)``.  With ``across_components``, pairs inside one
    component are of no use.  Each key's largest component is then split off,
    and the join is built so that its members only ever meet outsiders.
    """
    if across_components:
        found = _boxed_candidates(reps, threshold)
        if found is not None:
            return found
    sketch, texts = _gram_sketch(reps, threshold), reps.select("rep", "s", "component")
    indexed = materialize(texts.mapInPandas(_key_batches(threshold, INDEX, sketch), KEY_SCHEMA), "index")
    known = _key_filter(indexed)
    probing = materialize(texts.mapInPandas(_key_batches(threshold, PROBE, sketch, known), KEY_SCHEMA), "probes")
    keyed = indexed.union(probing)
    if across_components:
        sizes = keyed.groupBy("k", "component").agg(
            F.count("*").alias("c"), F.min("role").alias("r0"), F.max("role").alias("r1")
        )
        largest = (
            sizes.groupBy("k")
            .agg(
                F.max(F.struct("c", "component")).alias("top"),
                F.count("*").alias("parts"),
                F.min("r0").alias("r0"),
                F.max("r1").alias("r1"),
            )
            .where("parts > 1 AND r0 = 0 AND r1 = 1")
            .select(F.col("k").alias("gk"), F.col("top.component").alias("main"))
        )
        keyed = keyed.join(largest, F.col("k") == F.col("gk"))
        inside = F.col("component") == F.col("main")
        # slots: 0 = main x other, 1 = other x main, 2 = other x other
        index_slots = F.when(inside, F.array(F.lit(0))).otherwise(F.array(F.lit(1), F.lit(2)))
        probe_slots = F.when(inside, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(2)))
        slots = F.when(F.col("role") == 0, index_slots).otherwise(probe_slots)
        keyed = keyed.withColumn("slot", F.explode(slots))
    else:
        keyed = keyed.withColumn("slot", F.lit(0))
    side = lambda role, tag: keyed.where(F.col("role") == role).select(
        F.col("k").alias(f"k{tag}"), F.col("slot").alias(f"slot{tag}"), F.col("rep").alias(tag),
        F.col("n").alias(f"n{tag}"), F.col("p").alias(f"p{tag}"), F.col("component").alias(f"c{tag}"),
        *[F.col(w).alias(w + tag) for w in ("w0", "w1", "w2", "w3", "rest")],
    )
    meet = (F.col("ka") == F.col("kb")) & (F.col("slota") == F.col("slotb")) & (F.col("ca") != F.col("cb"))
    return side(0, "a").join(side(1, "b"), meet & _close(threshold) & _enough_letters(threshold)).select(
        "a", "b", F.col("ca").alias("u"), F.col("cb").alias("v")
    ).distinct()


WORDS = [f"w{i}" for i in range(CLASSES // 8)]
SUMS = [f"p{i}" for i in range(CLASSES // 8)]
ALIKE = WORDS[:BOX_WORDS], SUMS  # what the texts of a box share besides component and length: the finer first
BAG_SCHEMA = f"rep long, component long, n long, {', '.join(f'{w} long' for w in WORDS)}, rest long"


def _bag_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The letter counts of every text but the empty one."""
    for pdf in batches:
        for part in _slices(pdf):
            texts = _Texts(part["s"].tolist())
            bags, rest = _unary(texts.class_counts())
            yield pd.DataFrame(
                {
                    "rep": part["rep"].to_numpy(),
                    "component": part["component"].to_numpy(),
                    "n": texts.length,
                    **{w: bags[:, i] for i, w in enumerate(WORDS)},
                    "rest": rest,
                }
            )


def _tagged(df: DataFrame, tag: str) -> DataFrame:
    return df.toDF(*[c + tag for c in df.columns])


def _boxed_candidates(reps: DataFrame, threshold: int) -> DataFrame | None:
    """Pairs ``(a, b, u, v)`` across components whose lengths and letter counts allow a match, each once.

    None where keys are the cheaper way: too many boxes, or too many texts that
    would meet or be candidates.  What is spent until then grows with the texts.
    """
    bags = materialize(reps.select("rep", "s", "component").mapInPandas(_bag_batches, BAG_SCHEMA), "bags")
    bags = bags.withColumns({p: F.bit_count(w) for p, w in zip(SUMS, WORDS)})
    texts = bags.count()
    for alike in ALIKE:
        same = ["component", "n", *alike]
        boxes = materialize(_boxes(bags, same), "boxes")
        if boxes.count() ** 2 <= BOX_MEETINGS * texts:
            break
    else:
        return None
    pairs = materialize(_box_pairs(boxes, threshold), "boxpairs")
    met = pairs.agg(F.sum(F.col("sizea") * F.col("sizeb"))).first()[0] or 0
    if met > TEXT_MEETINGS * texts:
        return None
    parts = lambda size: F.ceil(F.col(size) / BOX_PART).cast("int")
    parted = pairs.select("boxa", "boxb", parts("sizea").alias("pa"), parts("sizeb").alias("pb"))
    for tag in "ab":
        parted = parted.withColumn(f"part{tag}", F.explode(F.sequence(F.lit(0), F.col(f"p{tag}") - 1)))
    owned = bags.join(boxes.select(*same, "box", "size"), same)
    owned = owned.withColumn("part", F.pmod(F.xxhash64("rep"), parts("size")).cast("int"))
    owned = materialize(owned.select("rep", "component", "n", *WORDS, "rest", "box", "part"), "boxed")
    most = CANDIDATES_A_TEXT * max(texts, FEW_TEXTS)
    share = met // max(most, 1)
    if share > 1:  # a sample tells about how many candidates there are, and nothing else
        drawn = F.pmod(F.xxhash64("boxa", "parta", "boxb", "partb"), F.lit(share)) == 0
        if _met_in_boxes(parted.where(drawn), owned, threshold).count() * share > most:
            return None
    return _met_in_boxes(parted, owned, threshold)


def _boxes(bags: DataFrame, same: list[str]) -> DataFrame:
    """Texts alike in ``same``, named by the least of them, with the most of all counts."""
    free = SUMS[BOX_WORDS:]
    most = {"rest": F.max("rest"), "most": F.max(sum((F.col(p) for p in free[1:]), F.col(free[0])))}
    most |= {w: F.bit_or(w) for w in WORDS} | {p: F.max(p) for p in SUMS}
    return bags.groupBy(*same).agg(
        F.min("rep").alias("box"), F.count("*").alias("size"), *[value.alias(c) for c, value in most.items() if c not in same]
    )


def _box_pairs(boxes: DataFrame, threshold: int) -> DataFrame:
    """Boxes ``(boxa, boxb)`` of different components that may have a match, and their sizes; a has the longer texts."""
    ratio = (200 - threshold) / threshold  # of the lengths of a match, at most
    width = F.lit(1.001 * np.log(ratio) / BANDS)
    band = F.floor(F.log(F.col("n").cast("double")) / width) if ratio > 1 else F.col("n")
    boxes = boxes.withColumn("band", band)
    left = _tagged(boxes.withColumn("deal", F.pmod(F.xxhash64("box"), F.lit(BOX_DEALS))), "a")
    left = left.withColumn("banda", F.explode(F.sequence(F.col("banda") - (BANDS if ratio > 1 else 0), "banda")))
    # few bytes and many meetings: partitions that are not put together again
    left = left.repartition(shuffle_partitions(boxes.sparkSession), "banda", "deala")
    right = _tagged(boxes.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BOX_DEALS - 1).cast("long")))), "b")
    shared = [
        F.least(F.bit_count(F.col(f"{w}a").bitwiseAND(F.col(f"{w}b"))), f"{p}a", f"{p}b") for w, p in zip(WORDS, SUMS)
    ]
    free = shared[BOX_WORDS:]
    common = sum(shared[:BOX_WORDS], F.least("resta", "restb")) + F.least(sum(free[1:], free[0]), "mosta", "mostb")
    total = F.col("na") + F.col("nb")
    meet = (
        (F.col("banda") == F.col("bandb"))
        & (F.col("deala") == F.col("dealb"))
        & (F.col("nb") * 200 >= total * threshold)
        & ((F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("boxa") < F.col("boxb"))))
        & (F.col("componenta") != F.col("componentb"))
        & (common * 200 >= total * threshold)
    )
    return left.join(right, meet).select("boxa", "boxb", "sizea", "sizeb")


def _met_in_boxes(parted: DataFrame, owned: DataFrame, threshold: int) -> DataFrame:
    """The texts of paired parts of boxes that have letters enough in common."""
    common = F.least("resta", "restb")
    for w in WORDS:
        common = common + F.bit_count(F.col(f"{w}a").bitwiseAND(F.col(f"{w}b")))
    enough = common * 200 >= (F.col("na") + F.col("nb")) * threshold
    a, b = (_tagged(owned, tag).withColumnsRenamed({f"box{tag}": f"in{tag}", f"part{tag}": f"of{tag}"}) for tag in "ab")
    met = parted.join(a, (F.col("boxa") == F.col("ina")) & (F.col("parta") == F.col("ofa"))).join(
        b, (F.col("boxb") == F.col("inb")) & (F.col("partb") == F.col("ofb")) & enough
    )
    return met.select(
        F.col("repa").alias("a"), F.col("repb").alias("b"), F.col("componenta").alias("u"), F.col("componentb").alias("v")
    )


def _verified(candidates: DataFrame, reps: DataFrame, threshold: int) -> DataFrame:
    """Candidates that reach the threshold, ``(a, b, lcs, total)`` with a < b."""
    left = reps.select(F.col("rep").alias("ra"), F.col("s").alias("sa"))
    right = reps.select(F.col("rep").alias("rb"), F.col("s").alias("sb"))
    pairs = candidates.join(left, F.col("a") == F.col("ra")).join(right, F.col("b") == F.col("rb"))
    scored = pairs.select(
        F.least("a", "b").alias("a"),
        F.greatest("a", "b").alias("b"),
        (F.length("sa") + F.length("sb")).alias("total"),
        lcs("sa", "sb").alias("lcs"),
    )
    return scored.where(F.col("lcs") * 200 >= F.col("total") * threshold)


def _run_batches(threshold: int, neighbours: int = 1):
    """Cut sorted texts into runs of matching neighbours, named by their first row.

    The ends of the partition keep their text, so that runs can be joined
    across partitions.  With more ``neighbours``, runs of which two texts match
    that are so near are linked as well, by a row of their first rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reps, texts, leaders = [], [], []  # the last rows of the batch before
        head = None
        for pdf in batches:
            if not len(pdf):
                continue
            old = len(reps)
            reps, texts = reps + pdf["rep"].tolist(), texts + pdf["s"].tolist()
            linked = _matching(texts[:-1], texts[1:], threshold)
            for i in range(old, len(reps)):
                leaders.append(leaders[i - 1] if i and linked[i - 1] else reps[i])
            out = _linked_runs(texts, leaders, old, neighbours, threshold)
            if head is None:
                head = reps[0]
            # the last row waits, as it may be the end of the partition
            waited = range(max(old - 1, 0), len(reps) - 1)
            out += [(reps[i], leaders[i], texts[i] if reps[i] == head else None) for i in waited]
            yield pd.DataFrame(out, columns=["rep", "leader", "edge"])
            reps, texts, leaders = reps[-neighbours:], texts[-neighbours:], leaders[-neighbours:]
        if reps:
            yield pd.DataFrame([(reps[-1], leaders[-1], texts[-1])], columns=["rep", "leader", "edge"])

    return run


def _linked_runs(texts: list[str], leaders: list[int], old: int, neighbours: int, threshold: int) -> list[tuple]:
    """Rows ``(leader, leader, None)`` of runs in which texts match that are some rows apart."""
    links, parent = [], {}

    def root(x: int) -> int:
        while x in parent:
            x = parent[x]
        return x

    for apart in range(2, neighbours + 1):
        at = [
            i
            for i in range(max(old, apart), len(texts))
            if min(len(texts[i]), len(texts[i - apart])) <= NEIGHBOUR_LETTERS and root(leaders[i]) != root(leaders[i - apart])
        ]
        for i, same in zip(at, _matching([texts[i - apart] for i in at], [texts[i] for i in at], threshold)):
            u, v = root(leaders[i]), root(leaders[i - apart])
            if same and u != v:
                parent[u] = v
                links.append((u, v, None))
    return links


def _matching(left: list[str], right: list[str], threshold: int) -> list[bool]:
    """Which pairs reach the threshold; lengths that rule it out are not compared."""
    total = [len(a) + len(b) for a, b in zip(left, right)]
    close = [200 * min(len(a), len(b)) >= threshold * n for a, b, n in zip(left, right, total)]
    common = lcs_lengths([a if c else "" for a, c in zip(left, close)], right)
    return [c and bool(200 * n >= threshold * t) for c, n, t in zip(close, common, total)]


def _by_letters(text: Column) -> Column:
    """Texts of the same letters side by side, by the text itself among them."""
    return F.concat(letter_key(text), text.cast("binary"))


def _orders() -> list:
    """Texts by their letters, read from several places on, the front after the end, and backwards."""

    def turned(text: Column, turn: int) -> Column:
        at = F.floor(F.length(text) * turn / TURNS).cast("int")
        return F.concat(F.substring(text, at + 1, F.length(text)), F.substring(text, F.lit(1), at))

    return [_by_letters, F.reverse, *[partial(turned, turn=i) for i in range(TURNS)]]


def _neighbour_edges(reps: DataFrame, threshold: int) -> DataFrame:
    """True edges found in linear time: runs of matching neighbours, in several orders."""
    found = None
    for order in _orders():
        sorted_texts = reps.select("rep", "s", order(F.col("s")).alias("o")).repartitionByRange("o").sortWithinPartitions("o")
        runs = materialize(
            sorted_texts.select("rep", "s").mapInPandas(
                _run_batches(threshold, NEIGHBOURS if order is _by_letters else 1), "rep long, leader long, edge string"
            ),
            "runs",
        )
        # at most two rows per partition have their text: the ends
        ends = runs.where("edge IS NOT NULL").withColumn("o", order(F.col("edge")))
        before = Window.orderBy("o")
        ends = ends.select(
            "leader",
            "edge",
            F.lag("leader").over(before).alias("other"),
            F.lag("edge").over(before).alias("text"),
        ).where("text IS NOT NULL")
        close = F.col("lcs") * 200 >= (F.length("edge") + F.length("text")) * threshold
        bridges = ends.withColumn("lcs", lcs("edge", "text")).where(close).select("leader", "other")
        edges = runs.where("rep <> leader").select("rep", "leader").union(bridges).toDF("u", "v")
        found = edges if found is None else found.union(edges)
    return found


# --------------------------------------------------------------------------
# operators
# --------------------------------------------------------------------------


def _check(df: DataFrame, columns: list[str] | None, threshold: int, max_rows: int | None):
    require_row_id(df)
    ship_package()
    if not 1 <= threshold <= 100:
        raise ValueError("the threshold must lie between 1 and 100")
    if columns is None:
        columns = text_columns(df)
    require_columns(df, *columns)
    if max_rows is not None:
        df = df.orderBy(ROW_ID).limit(max_rows)
    return df, list(columns), int(threshold)


def similar_pairs(
    df: DataFrame,
    columns: list[str] | None = None,
    threshold: int = DEFAULT_THRESHOLD,
    max_rows: int | None = None,
) -> DataFrame:
    """Matching pairs ``(left_row_id, right_row_id, score)`` of distinct texts.

    A text that occurs several times stands for all its rows under the
    smallest row id; :func:`text_members` lists the rows behind each.
    """
    df, columns, threshold = _check(df, columns, threshold, max_rows)
    schema = "left_row_id long, right_row_id long, score double"
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    _, reps = _representatives(df, columns)
    reps = reps.withColumn("component", F.col("rep"))
    found = _verified(_candidates(reps, threshold, across_components=False), reps, threshold)
    return found.select(
        F.col("a").alias("left_row_id"),
        F.col("b").alias("right_row_id"),
        (F.lit(200.0) * F.col("lcs") / F.col("total")).alias("score"),
    )


def text_members(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every row's text representative ``(row_id, representative)``: the rows behind the ids of :func:`similar_pairs`.

    A representative is the least row id among the rows whose sorted words are
    equal.  A row of its own text, or without any text, stands for itself or for
    the first of its kind; an aggregate and a join on the text's digest, no pairs.
    """
    require_row_id(df)
    columns = text_columns(df) if columns is None else list(columns)
    require_columns(df, *columns)
    rows = df.select(F.col(ROW_ID), F.unhex(F.sha2(sorted_words(row_text(df, columns)), 256)).alias("digest"))
    least = rows.groupBy(F.col("digest").alias("d")).agg(F.min(ROW_ID).alias("representative"))
    return rows.join(least, F.col("digest") == F.col("d")).select(F.col(ROW_ID).alias("row_id"), "representative")


def similar_groups(
    df: DataFrame,
    columns: list[str] | None = None,
    threshold: int = DEFAULT_THRESHOLD,
    max_rows: int | None = None,
) -> DataFrame:
    """Rows in groups of likely duplicates ``(group_id, keep_row_id, row_id, group_size)``.

    Groups are the connected components of the matching pairs; the first row
    is the one to keep.  One output row per member, so large groups stay
    spread over tasks.
    """
    df, columns, threshold = _check(df, columns, threshold, max_rows)
    if not columns:
        schema = "group_id long, keep_row_id long, row_id long, group_size long"
        return df.sparkSession.createDataFrame([], schema)
    rows, reps = _representatives(df, columns)

    linked = connected_components(_neighbour_edges(reps, threshold))
    first = _labelled(reps, linked)
    candidates = materialize(_candidates(first, threshold, across_components=True), "candidates")
    merged = _merged(candidates, first, threshold).withColumnRenamed("component", "root")
    final = first.join(merged, F.col("component") == F.col("node"), "left").select(
        "rep", "digest", "copies", F.coalesce("root", "component").alias("g")
    )
    sizes = final.groupBy(F.col("g").alias("sg")).agg(F.sum("copies").alias("group_size")).where("group_size > 1")
    grouped = final.join(sizes, F.col("g") == F.col("sg")).select(F.col("digest").alias("d"), "g", "group_size")
    return rows.join(grouped, F.col("digest") == F.col("d")).select(
        F.col("g").alias("group_id"),
        F.col("g").alias("keep_row_id"),
        F.col(ROW_ID).alias("row_id"),
        "group_size",
    )


def _merged(candidates: DataFrame, reps: DataFrame, threshold: int) -> DataFrame:
    """Components ``(node, component)`` of the components that a candidate links.

    Two components take one true link.  So a few candidates of each two are
    verified first, and of the others only those that still lie across.
    """
    order = Window.partitionBy("u", "v").orderBy(F.xxhash64("a", "b"), "a", "b")
    few = candidates.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= FIRST_TRIES)
    links = materialize(_links(few, reps, threshold), "links")
    known = connected_components(links)
    root = lambda of: known.select(F.col("node").alias(f"node_{of}"), F.col("component").alias(f"root_{of}"))
    rest = (
        candidates.join(root("u"), F.col("u") == F.col("node_u"), "left")
        .join(root("v"), F.col("v") == F.col("node_v"), "left")
        .where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v"))
    )
    return connected_components(links.union(_links(rest, reps, threshold)))


def _links(candidates: DataFrame, reps: DataFrame, threshold: int) -> DataFrame:
    """The components ``(u, v)`` of candidates that reach the threshold."""
    of = reps.select(F.col("rep"), F.col("component"))
    found = _verified(candidates.select("a", "b"), reps, threshold)
    left, right = of.toDF("ra", "u"), of.toDF("rb", "v")
    return found.join(left, F.col("a") == F.col("ra")).join(right, F.col("b") == F.col("rb")).select("u", "v").distinct()


def _labelled(reps: DataFrame, components: DataFrame) -> DataFrame:
    """Representatives with a component; unlinked ones are their own."""
    joined = reps.join(components, F.col("rep") == F.col("node"), "left")
    return materialize(
        joined.select("rep", "digest", "s", "copies", F.coalesce("component", "rep").alias("component")), "texts"
    )


def duplicates_to_drop(groups: DataFrame) -> DataFrame:
    """Row ids of every group member but the one to keep, for ``drop_rows``."""
    return groups.where("row_id <> keep_row_id").select(F.col("row_id").alias(ROW_ID))


def ordered_groups(groups: DataFrame) -> DataFrame:
    """Largest group first, then by first row, then by row."""
    return groups.orderBy(F.col("group_size").desc(), "group_id", "row_id")
