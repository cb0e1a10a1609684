"""Repair of the structure of conversations by target alignment.

A sound conversation is empty, or has an optional system turn and then user and
assistant turns in turn: its role initials are ``(s?(ua)+)?``.  The turns of a
conversation are aligned to such a string by edits: Keep (free), Rerole to user
or assistant (2), Delete (3), Insert of an empty turn (2).  Blank turns and
duplicates must go, and a truncated turn that stays costs 1.

The alignment is Wagner and Fischer's table.  Strings of all feasible lengths are
prefixes of ``uaua...`` or ``suaua...``, so one table of each kind has them all in
its last row.  A walk that edits greedily gives an incumbent cost; cells dearer
than that, and by Ukkonen's argument all outside a band around the diagonal, are
left out.  A cell holds its cost and the audit (the initials of the edits so far),
and the least pair wins: cheapest first, then least in ASCII order.

Conversations are dealt by ranges of (conv_id, turn), so one of any size spreads
over many tasks.  What lies whole in a partition and has at most `BLOCK` turns,
which is nearly everything, is repaired there.  The rest is cut into blocks: a
block is aligned once for each state in which it may be entered and left, and the
blocks' costs and audits are composed in order by a stream that holds only what
the states do not have in common.

* Turns are ordered by number, those without one first, then by digest (MD5 of
  role and text).  Null roles and texts are one space.
* Rows without a conv_id belong to no conversation.  Repeated rows are duplicates.
* An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom.llm.batches import ready_workers
from sheetloom.llm.turns import turn_digest
from sheetloom.session import materialize, shuffle_partitions

BLOCK = 64
RANGE_ROWS = 200_000  # turns of a range partition
CACHED = 50_000  # alignments that a worker keeps, of at most BLOCK characters each
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SPACE = " \t\n\x0b\x0c\r"
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

# where an alignment stands: at the start, after the system turn, before an assistant's, after an assistant's
START, SYSTEM, ASKED, ANSWERED = "SPAU"
ROLE_OF = {"u": "user", "a": "assistant"}

ROWS = "conv_id bigint, turn bigint, role string, text string, digest string, initial string, fault int"
_RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired string, repaired_sha256 string"
CUT = (
    f"{RESULT}, part bigint, seq bigint, "
    "turns array<bigint>, roles array<string>, texts array<string>, digests array<string>, initials array<string>, faults array<int>"
)
STATS = "conv_id bigint, part bigint, seq bigint, signature string, stats string"
SLICES = f"{STATS}, state string, audit string, cost bigint"
PIECES = "conv_id bigint, part bigint, seq bigint, stats string, audit string, cost bigint, piece string"


# --------------------------------------------------------------------------
# alignment
# --------------------------------------------------------------------------

# A turn's letter in a signature: X must go; else s, u, a by the role's initial or o for others, as a capital if truncated.


def _letter(initial: str, fault: int, seen: bool) -> str:
    if fault == 1 or seen:
        return "X"
    letter = initial if initial in ("s", "u", "a") else "o"
    return letter.upper() if fault == 2 else letter


def _stay(letter: str) -> int:
    return TRUNCATED if letter.isupper() else 0


def _wanted(state: str) -> str:
    """The initial that comes next (at the start it may also be s)."""
    return "a" if state == ASKED else "u"


def _next(state: str) -> str:
    return ANSWERED if state == ASKED else ASKED


def _greedy(signature: str, state: str) -> int:
    """The cost of keeping or reroling all that may stay, up to the end of an answer; an upper bound of the cheapest."""
    cost = 0
    for letter in signature:
        if letter == "X":
            cost += DELETE
        else:
            cost += _stay(letter) + (0 if letter.lower() == _wanted(state) else REROLE)
            state = _next(state)
    return cost + (INSERT if state == ASKED else 0)


def _last_row(signature: str, target, incumbent: int) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the whole signature against the first j symbols of a target, for each j within the incumbent's band."""
    left, right = incumbent // DELETE, incumbent // INSERT
    row: dict[int, tuple[int, str]] = {0: (0, "")}
    for i in range(len(signature) + 1):
        if i:
            above, row = row, {}
            letter = signature[i - 1]
            stay = _stay(letter)
        for j in range(max(0, i - left), i + right + 1):
            found = row.get(j)  # only the very first cell
            if i:
                up = above.get(j)
                if up is not None:
                    found = (up[0] + DELETE, up[1] + "D")
                corner = above.get(j - 1)
                if corner is not None and letter != "X":
                    symbol = target(j - 1)
                    if letter.lower() == symbol:
                        kept = (corner[0] + stay, corner[1] + "K")
                        found = kept if found is None else min(found, kept)
                    elif symbol != "s":
                        changed = (corner[0] + REROLE + stay, corner[1] + "R")
                        found = changed if found is None else min(found, changed)
            before = row.get(j - 1)
            if before is not None and target(j - 1) != "s":
                put = (before[0] + INSERT, before[1] + "I")
                found = put if found is None else min(found, put)
            if found is not None and found[0] <= incumbent:
                row[j] = found
    return row


@lru_cache(CACHED)
def alignments(signature: str, entry: str, every_end: bool = True) -> dict[str, tuple[int, str]]:
    """The cheapest (cost, audit) from a state to each state that the turns can lead to; else only to the cheapest sound end."""
    best: dict[str, tuple[int, str]] = {}

    def offer(state: str, found: tuple[int, str]) -> None:
        if state not in best or found < best[state]:
            best[state] = found

    n = len(signature)
    incumbent = _greedy(signature, entry) + (2 * INSERT if every_end else 0)  # from where the walk ends, an answer is two insertions away at most
    first = 1 if entry == ASKED else 0
    for j, found in _last_row(signature, lambda j: "ua"[(j + first) % 2], incumbent).items():
        offer(entry if j == 0 else (ASKED if (j + first) % 2 else ANSWERED), found)
    if entry in (START, SYSTEM):  # all turns go
        offer(entry, (DELETE * n, "D" * n))
    if entry == START and "s" in signature.lower():
        for j, found in _last_row(signature, lambda j: "s" if j == 0 else "au"[j % 2], incumbent).items():
            if j > 1:
                offer(ANSWERED if j % 2 else ASKED, found)
        for k, letter in enumerate(signature):  # only a system turn stays
            if letter.lower() == "s":
                offer(SYSTEM, (DELETE * (n - 1) + _stay(letter), "D" * k + "K" + "D" * (n - 1 - k)))
    return best


def cheapest(signature: str) -> tuple[int, str]:
    """The cheapest (cost, audit) that makes a whole conversation sound."""
    ends = alignments(signature, START, False)
    return min(ends[s] for s in (START, ANSWERED) if s in ends)


def repaired(audit: str, state: str, roles: list[str], texts: list[str], initials: list[str]) -> tuple[list[str], str]:
    """The turns that an audit leaves, as ``role:text``, and the state after them."""
    out, i = [], 0
    for edit in audit:
        role, text = ROLE_OF[_wanted(state)], ""
        if edit != "I":
            if edit != "D":
                text = texts[i]
            if edit == "K":
                role = roles[i]
            i += 1
        if edit == "D":
            continue
        out.append(f"{role}:{text}")
        state = SYSTEM if edit == "K" and state == START and initials[i - 1] == "s" else _next(state)
    return out, state


def _stats(turns: list[int | None], initials: list[str], letters: list[str], faults: list[int]) -> dict:
    known = [t for t in turns if t is not None]  # in order
    pairs = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return {
        "low": known[0] if known else None, "high": known[-1] if known else None, "distinct": len(set(known)), "first": initials[0], "last": initials[-1],
        "blank": faults.count(1), "duplicate": sum(x == "X" and f != 1 for x, f in zip(letters, faults, strict=True)),
        "truncated": sum(x != "X" and f == 2 for x, f in zip(letters, faults, strict=True)), "illegal": pairs,
    }


def _added(a: dict, b: dict) -> dict:
    """The stats of two neighbouring blocks together."""
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated", "illegal", "distinct")}
    out["illegal"] += a["last"] + b["first"] not in ("su", "ua", "au")
    out["distinct"] -= a["high"] is not None and a["high"] == b["low"]
    out["low"] = b["low"] if a["low"] is None else a["low"]
    out["high"] = a["high"] if b["high"] is None else b["high"]
    return out | {"first": a["first"], "last": b["last"]}


def _measures(stats: dict, cost: int) -> tuple:
    gaps = stats["high"] - stats["low"] + 1 - stats["distinct"] if stats["low"] is not None else 0
    return (gaps, stats["blank"], stats["duplicate"], stats["truncated"], stats["illegal"], cost)


# --------------------------------------------------------------------------
# tasks
# --------------------------------------------------------------------------


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    """An Arrow schema of the few types used here."""
    kinds = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}
    kinds |= {f"array<{k}>": pa.list_(t) for k, t in kinds.items()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _cut(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows in order -> results of conversations that lie whole here and are short, blocks of all others; see `CUT`."""
    part, schema = TaskContext.get().partitionId(), _arrow(CUT)
    held: list[tuple] = []  # turns of the current conversation that are not out yet
    seq, first, out = 0, True, []

    def block() -> None:
        nonlocal seq
        _, turns, roles, texts, digests, initials, faults = zip(*held, strict=True)
        out.append((held[0][0], *[None] * 9, part, seq, turns, roles, texts, digests, initials, faults))
        seq += 1
        held.clear()

    def whole() -> None:
        conv, turns, roles, texts, digests, initials, faults = (list(x) for x in zip(*held, strict=True))
        seen: set[str] = set()
        letters = []
        for digest, initial, fault in zip(digests, initials, faults, strict=True):
            letters.append(_letter(initial, fault, digest in seen))
            seen.add(digest)
        cost, audit = cheapest("".join(letters))
        text = "\n".join(repaired(audit, START, roles, texts, initials)[0])
        stats = _stats(turns, initials, letters, faults)
        out.append((conv[0], *_measures(stats, cost), audit, text, hashlib.sha256(text.encode()).hexdigest(), None, None, *[None] * 6))
        held.clear()

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][0] != row[0]:
                if first or seq:
                    block()
                else:
                    whole()
                first, seq = False, 0
            elif len(held) == limit:
                block()
            held.append(row)
        yield _batch(out, schema)
        out = []
    if held:
        block()  # it may go on in the next partition
        yield _batch(out, schema)


def _aligned_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, part, seq, turns, initials, faults, places of duplicates -> `STATS`."""
    schema = _arrow(STATS)
    for batch in batches:
        out = []
        for conv, part, seq, turns, initials, faults, repeats in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            again = set(repeats or ())
            letters = [_letter(x, f, i in again) for i, (x, f) in enumerate(zip(initials, faults, strict=True))]
            stats = _stats(turns, initials, letters, faults)
            table = {entry: alignments("".join(letters), entry) for entry in (START, SYSTEM, ASKED, ANSWERED)}
            out.append((conv, part, seq, "".join(letters), json.dumps({"stats": stats, "table": table})))
        yield _batch(out, schema)


class _Composer:
    """Blocks of one conversation, in order, to the audit of each."""

    def __init__(self) -> None:
        self.best: dict[str, tuple[int, str]] = {START: (0, "")}  # audits without what is settled
        self.waiting: list[tuple] = []  # blocks whose audits are not settled
        self.settled = ""  # of the first of these
        self.state = START  # before it

    def add(self, row: tuple, table: dict) -> Iterator[tuple]:
        best: dict[str, tuple[int, str]] = {}
        for entry, (cost, audit) in self.best.items():
            for end, (more, edits) in table[entry].items():
                found = (cost + more, audit + edits)
                if end not in best or found < best[end]:
                    best[end] = found
        self.best = best
        self.waiting.append(row)
        same = len(os.path.commonprefix([a for _, a in best.values()]))
        self._settle(same)
        yield from self._ready(False)

    def _settle(self, n: int) -> None:
        self.settled += next(iter(self.best.values()))[1][:n]
        self.best = {s: (c, a[n:]) for s, (c, a) in self.best.items()}

    def _ready(self, last: bool, cost: int | None = None) -> Iterator[tuple]:
        while self.waiting and (last or len(self.waiting) > 1):  # the last block waits for what may follow its turns
            conv, part, seq, signature, stats = self.waiting[0]
            rows = at = 0
            while at < len(self.settled) and rows < len(signature):
                rows += self.settled[at] != "I"
                at += 1
            final = last and len(self.waiting) == 1
            if rows < len(signature) and not final:
                return
            audit = self.settled if final else self.settled[:at]
            yield (conv, part, seq, signature, stats, self.state, audit, cost if final else None)
            state = self.state
            i = 0
            for edit in audit:
                if edit != "I":
                    i += 1
                if edit != "D":
                    state = SYSTEM if edit == "K" and state == START and signature[i - 1].lower() == "s" else _next(state)
            self.state, self.settled = state, self.settled[len(audit) :]
            self.waiting.pop(0)

    def end(self) -> Iterator[tuple]:
        cost, audit = min(self.best[s] for s in (START, ANSWERED) if s in self.best)
        self.settled += audit
        yield from self._ready(True, cost)


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`STATS` in order -> `SLICES`: each block's part of the audit, and the state it starts in."""
    schema, current, composer = _arrow(SLICES), None, _Composer()
    for batch in batches:
        out: list[tuple] = []
        for conv, part, seq, signature, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conv != current:
                if current is not None:
                    out.extend(composer.end())
                current, composer = conv, _Composer()
            both = json.loads(packed)
            table = {e: {s: (c, a) for s, (c, a) in ends.items()} for e, ends in both["table"].items()}
            out.extend(composer.add((conv, part, seq, signature, json.dumps(both["stats"])), table))
        yield _batch(out, schema)
    if current is not None:
        yield _batch(list(composer.end()), schema)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their part of the audit -> `PIECES`."""
    schema = _arrow(PIECES)
    for batch in batches:
        out = []
        for conv, part, seq, stats, state, audit, cost, roles, texts, initials in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            piece, _ = repaired(audit, state, roles, texts, initials)
            out.append((conv, part, seq, stats, audit, cost, "\n".join(piece)))
        yield _batch(out, schema)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`PIECES` in order -> `RESULT`; a turn that stays is never empty, so an empty piece has none."""
    schema, current = _arrow(RESULT), None
    stats, audits, texts, cost = {}, [], [], 0

    def result() -> tuple:
        text = "\n".join(t for t in texts if t)
        return (current, *_measures(stats, cost), "".join(audits), text, hashlib.sha256(text.encode()).hexdigest())

    for batch in batches:
        out = []
        for conv, _, _, packed, audit, last, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conv != current:
                if current is not None:
                    out.append(result())
                current, audits, texts, stats = conv, [], [], {}
            stats = _added(stats, json.loads(packed)) if stats else json.loads(packed)
            audits.append(audit)
            texts.append(piece)
            cost = last if last is not None else cost
        yield _batch(out, schema)
    if current is not None:
        yield _batch([result()], schema)


# --------------------------------------------------------------------------
# tables
# --------------------------------------------------------------------------


def faulty(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """`ROWS` of a table of turns: digest, initial of the role, and fault (1 blank, 2 truncated, if it is no duplicate; else 0)."""
    who, what = F.coalesce(F.col(role), F.lit(" ")), F.coalesce(F.col(text), F.lit(" "))
    named = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), who.alias("role"), what.alias("text")
    )
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(bare == "", 1).when(F.substring(bare, -1, 1).isin(".", "!", "?"), 0).otherwise(2)
    return named.select("*", turn_digest(F.col("role"), F.col("text")).alias("digest"), F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults by crc32("conv_id:turn") % 20: 0 drops a row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it,
    4 makes it the user's.  Nulls are one space, in that key too."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    marked = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    changed = marked.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("time"))
    return changed.drop("time")


def _ordered(df: DataFrame) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")


def repair_conversations(turns: DataFrame, block: int = BLOCK, **columns: str) -> DataFrame:
    """One row for each conversation that has turns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, ``repaired``
    (its turns as ``role:text``, one below the other) and repaired_sha256."""
    spark = turns.sparkSession
    ready_workers(spark)
    rows = materialize(faulty(turns, **columns).withColumn("salt", F.monotonically_increasing_id()), "repair-turns")
    ranges = max(shuffle_partitions(spark), math.ceil(rows.count() / RANGE_ROWS))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("salt")]
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop("salt")
    cut = materialize(dealt.mapInArrow(lambda batches: _cut(batches, block), CUT), "repair-cut")
    result = [x.split()[0] for x in RESULT.split(", ")]
    blocks = cut.where("part IS NOT NULL")
    place = F.struct("part", "seq", "i")
    single = blocks.select("conv_id", "part", "seq", F.posexplode("digests").alias("i", "digest"))
    firsts = single.groupBy("conv_id", "digest").agg(F.min(place).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "head")
    later = single.join(firsts, (F.col("conv_id") == F.col("c")) & (F.col("digest") == F.col("d")) & (F.col("head") != place))
    repeats = later.groupBy(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("seq").alias("s")).agg(F.collect_list("i").alias("repeats"))
    here = lambda: (F.col("conv_id") == F.col("c")) & (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s"))
    marked = blocks.join(repeats, here(), "left").select("conv_id", "part", "seq", "turns", "initials", "faults", "repeats")
    stats = materialize(marked.mapInArrow(_aligned_blocks, STATS), "repair-blocks")
    slices = materialize(_ordered(stats).mapInArrow(_composed, SLICES), "repair-audits")
    slices = slices.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("seq").alias("s"), "stats", "state", F.col("audit").alias("edits"), F.col("cost").alias("total"))
    edited = blocks.join(slices, here()).select("conv_id", "part", "seq", "stats", "state", "edits", "total", "roles", "texts", "initials")
    pieces = edited.mapInArrow(_texts, PIECES)
    long = _ordered(pieces).mapInArrow(_joined, RESULT)
    return cut.where("part IS NULL").select(result).unionByName(long)


def repair_report(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """:func:`repair_conversations` without the text, of :func:`damaged` turns and with the conversations that lost all of them."""
    ids = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = repair_conversations(damaged(turns), block).drop("repaired").withColumnRenamed("conv_id", "c")
    joined = ids.join(found, F.col("conv_id") == F.col("c"), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _RESULT]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"))
