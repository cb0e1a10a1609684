"""Near duplicates by a chosen-path set similarity join over minwise tokens.

A document is the set of its distinct word shingles.  Equal sets are one class,
stood for by its least doc_id.  `TREES` independent trees put every class into
the node of a minwise token; nodes of more than `LEAF` classes branch on
further tokens of the path's own choice, small nodes are compared
exhaustively by signatures of `SIGNATURE` one-byte minwise tokens.  Pairs whose
signatures allow the wanted similarity are checked on the full sets.

Two passes keep dense groups cheap without dropping a comparison.  The first
proposes only a maximum spanning forest of each node (large nodes in hashed
parts), which links nearly all of a group of near copies.  The second goes
down the trees and compares only across the components found so far: a large
node all of whose classes are connected is left; where nearly all are, the few
others meet the rest part by part; else the node branches.  A pair of
similarity 0.75 shares a root node but with probability 0.25 ** TREES, and each
further branching of that path keeps it with 1 - 0.25 ** BRANCHES.

Shingles are told apart by 64-bit hashes.  Rows that share a doc_id are one
document if their sets are equal; else each text of the doc_id is a document of
its own, with a 64-bit hash of id and text in the id's place until the end, so
that no text goes for what another of its doc_id is like.  Null and empty texts
have no shingles and no links; rows without a doc_id are their own and have no
component id.  Repeated rows get equal results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetloom.llm.batches import ready_workers
from sheetloom.llm.words import Words, mix, text_words
from sheetloom.operators.components import connected_components
from sheetloom.session import materialize

SHINGLE = 5
PERCENT = 75
TREES = 8
BRANCHES = 2
LEAF = 512
SIGNATURE = 128
MAX_DEPTH = 6
GROUP_ROWS = 4096
LEAST_GROUPS = 64
DOCS_PER_FILE = 20_000
LEAST_FILES = 6
BROADCAST_IDS = 1_000_000  # ids of checked documents that are broadcast at most (8 MB); beyond it, a shuffle join

_SEEDS = np.arange(1, 1000, dtype=np.uint64)
_BYTE_FACTORS = (mix(_SEEDS[:SIGNATURE] * np.uint64(0x51ED2701)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_TREE_FACTORS = mix(_SEEDS[:TREES] * np.uint64(0x2545F491)) | np.uint64(1)


def _saved(df: DataFrame, label: str, n_docs: int) -> DataFrame:
    """A written table in files of the results for about `DOCS_PER_FILE` documents; many tiny files cost more than their rows."""
    return materialize(df.coalesce(max(LEAST_FILES, math.ceil(n_docs / DOCS_PER_FILE))), label)


def least_matches(percent: int) -> int:
    """Equal signature bytes below which a pair of that similarity is 4 standard deviations off."""
    p = percent / 100
    p += (1 - p) / 256  # different tokens share a byte now and then
    return math.floor(SIGNATURE * p - 4 * math.sqrt(SIGNATURE * p * (1 - p)))


def _shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts of a chunk in order, and where each text's begin (the number of all last)."""
    hashes, inside = words.windows(SHINGLE)
    place = np.flatnonzero(inside)
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    whole = np.zeros(len(short), np.uint64)
    for i, d in enumerate(short.tolist()):  # fewer words: the whole sequence is one shingle
        part = words.hashes[words.first[d] : words.first[d + 1]]
        whole[i] = mix(np.array([np.sum(mix(part + _SEEDS[: len(part)]), dtype=np.uint64) ^ np.uint64(len(part))], np.uint64))[0]
    doc = np.concatenate([words.doc[place], short])
    values = np.concatenate([hashes[place], whole])
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    doc, values = doc[new], values[new]
    return values, np.searchsorted(doc, np.arange(words.n_docs + 1))


def _sketch(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The signature and the tree keys of a set."""
    low = np.full(SIGNATURE, 0xFFFFFFFF, np.uint32)
    keys = np.full(TREES, 0xFFFFFFFFFFFFFFFF, np.uint64)
    half = (values >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(values), 2048):
        low = np.minimum(low, (half[a : a + 2048, None] * _BYTE_FACTORS).min(axis=0))
        keys = np.minimum(keys, (values[a : a + 2048, None] * _TREE_FACTORS).min(axis=0))
    return low.astype(np.uint8).tobytes(), mix(keys + np.arange(TREES, dtype=np.uint64)).astype(np.int64)


def document_sets(docs: DataFrame) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: n_shingles, two set digests, the signature and the tree keys (null without shingles)."""
    ready_workers(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for words in text_words(batch.column(1), lower=True):
                values, first = _shingles(words)
                sizes = np.diff(first)
                zero = np.zeros(1, np.uint64)
                one = np.concatenate([zero, np.cumsum(values, dtype=np.uint64)])[first]
                two = np.concatenate([zero, np.cumsum(mix(values ^ np.uint64(0xA5A5)), dtype=np.uint64)])[first]
                sketches = [_sketch(values[x:y]) if x < y else (None, None) for x, y in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(words.row, words.n_docs),
                        pa.array(sizes, pa.int64()),
                        pa.array(np.diff(one).astype(np.int64)),
                        pa.array(np.diff(two).astype(np.int64)),
                        pa.array([s for s, _ in sketches], pa.binary()),
                        pa.array([k for _, k in sketches], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "set_a", "set_b", "signature", "keys"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        sketch, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, signature binary, keys array<bigint>"
    )


def _forest(alike: np.ndarray, least: int) -> list[tuple[int, int]]:
    """A maximum spanning forest of the pairs with at least so many matches."""
    n = len(alike)
    best = np.full(n, -1)
    source = np.zeros(n, np.int64)
    open_ = np.ones(n, bool)
    out = []
    for _ in range(n):
        reach = np.where(open_, best, -2)
        i = int(reach.argmax())
        if reach[i] >= least:
            out.append((int(source[i]), i))
        open_[i] = False
        better = open_ & (alike[i] > best)
        best[better], source[better] = alike[i][better], i
    return out


def _alike(signatures: np.ndarray) -> np.ndarray:
    """Equal bytes of all pairs of rows."""
    n = len(signatures)
    out = np.zeros((n, n), np.int16)
    for a in range(0, n, 64):
        out[a : a + 64] = (signatures[a : a + 64, None, :] == signatures[None, :, :]).sum(axis=2, dtype=np.int16)
    return out


def _sorted_cells(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The rows by cell, with the first row and the number of rows of each."""
    cell = table["cell"].to_numpy()
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    heads = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    return table.take(pa.array(order)), heads, np.diff(np.append(heads, len(cell)))


def _signatures(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint8).reshape(-1, SIGNATURE)


def _in_groups(cells: DataFrame, rows: int) -> GroupedData:
    """Whole cells dealt into groups of about so many rows."""
    groups = max(LEAST_GROUPS, math.ceil(cells.count() / rows))
    return cells.withColumn("group", F.pmod(F.xxhash64("cell"), F.lit(groups))).groupBy("group")


def _proposed(cells: DataFrame, least: int) -> DataFrame:
    """Pairs ``(a, b)``, a < b: a maximum spanning forest of each of ``cells (cell, rep, signature)`` by signature."""

    def propose(table: pa.Table) -> pa.Table:
        table, heads, sizes = _sorted_cells(table)
        rep, signature = table["rep"].to_numpy(), _signatures(table)
        twos = heads[sizes == 2]
        hit = twos[(signature[twos] == signature[twos + 1]).sum(axis=1) >= least]
        left, right = [rep[hit]], [rep[hit + 1]]
        for h, n in zip(heads[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            pairs = np.array(_forest(_alike(signature[h : h + n]), least), np.int64).reshape(-1, 2)
            left.append(rep[h + pairs[:, 0]])
            right.append(rep[h + pairs[:, 1]])
        a, b = np.concatenate(left), np.concatenate(right)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return _in_groups(cells, GROUP_ROWS).applyInArrow(propose, "a bigint, b bigint").where("a < b").distinct()


def _near_others(signature: np.ndarray, component: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows outside the main component, and for each which rows of other components its signature is near."""
    names, times = np.unique(component, return_counts=True)
    others = np.flatnonzero(component != names[times.argmax()])
    near = np.zeros((len(others), len(component)), bool)
    for a in range(0, len(others), 64):
        part = others[a : a + 64]
        near[a : a + 64] = (signature[part, None, :] == signature[None, :, :]).sum(axis=2, dtype=np.int16) >= least
        near[a : a + 64] &= component[part, None] != component[None, :]
    return others, near


def _touched(cells: DataFrame, least: int) -> DataFrame:
    """The rows of ``cells (cell, rep, signature, component)`` with a near signature of another component in their cell."""

    def touch(table: pa.Table) -> pa.Table:
        table, heads, sizes = _sorted_cells(table)
        component, signature = table["component"].to_numpy(), _signatures(table)
        keep = np.zeros(len(component), bool)
        for h, n in zip(heads.tolist(), sizes.tolist(), strict=True):
            others, near = _near_others(signature[h : h + n], component[h : h + n], least)
            keep[h : h + n] = near.any(axis=0)
            keep[h + others] |= near.any(axis=1)
        return table.filter(pa.array(keep)).select(["cell", "rep", "signature", "component"])

    return _in_groups(cells, GROUP_ROWS).applyInArrow(touch, "cell bigint, rep bigint, signature binary, component bigint")


def _full_sets(docs: DataFrame, repeated: DataFrame, ids: DataFrame, n_docs: int) -> DataFrame:
    """``(id, shingles)`` of the documents with these ids, one row each; the ids in ``repeated (again)`` have several rows of one set."""
    ids = _saved(ids.distinct(), "near-ids", n_docs)
    small = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    chosen = docs.join(small, docs["doc_id"] == small["id"], "left_semi").select("doc_id", "text")
    if not repeated.isEmpty():
        again = F.col("doc_id") == F.col("again")
        chosen = chosen.join(repeated, again, "left_anti").unionByName(chosen.join(repeated, again, "left_semi").dropDuplicates(["doc_id"]))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in text_words(batch.column(1), lower=True):
                values, first = _shingles(words)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(words.row, words.n_docs), lists], ["id", "shingles"])

    return materialize(chosen.mapInArrow(spell, "id bigint, shingles array<bigint>"), "near-sets")


def _confirmed(docs: DataFrame, repeated: DataFrame, pairs: DataFrame, percent: int, n_docs: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""
    sets = _full_sets(docs, repeated, pairs.select(F.explode(F.array("a", "b")).alias("id")), n_docs)
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    counted = pairs.join(one, "a").join(two, "b").select("a", "b", shared.alias("shared"), (F.size("x") + F.size("y") - shared).alias("union"))
    return counted.where(100 * F.col("shared") >= percent * F.col("union")).select("a", "b")


def _confirmed_across(docs: DataFrame, repeated: DataFrame, touched: DataFrame, least: int, percent: int, n_docs: int) -> DataFrame:
    """Pairs ``(a, b)`` of different components in a cell whose full sets are similar enough.

    A cell gets every set once, however many near pairs it has.
    """
    sets = _full_sets(docs, repeated, touched.select(F.col("rep").alias("id")), n_docs).withColumnRenamed("id", "rep")

    def confirm(table: pa.Table) -> pa.Table:
        table, heads, sizes = _sorted_cells(table)
        rep, component, signature = table["rep"].to_numpy(), table["component"].to_numpy(), _signatures(table)
        lists = table["shingles"].combine_chunks()
        flat, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for h, n in zip(heads.tolist(), sizes.tolist(), strict=True):
            others, near = _near_others(signature[h : h + n], component[h : h + n], least)
            if not near.any():
                continue
            starts = at[h : h + n + 1] - at[h]
            names, shingle = np.unique(flat[at[h] : at[h + n]], return_inverse=True)
            size = np.diff(starts)
            for i, row in zip(others.tolist(), near, strict=True):
                if row.any():
                    own = np.zeros(len(names), bool)
                    own[shingle[starts[i] : starts[i + 1]]] = True
                    shared = np.add.reduceat(own[shingle], starts[:-1], dtype=np.int64)
                    linked = np.flatnonzero(row & (100 * shared >= percent * (size[i] + size - shared)))
                    left.append(np.full(len(linked), rep[h + i]))
                    right.append(rep[h + linked])
        a, b = np.concatenate(left), np.concatenate(right)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    rows = touched.join(sets, "rep").select("cell", "rep", "signature", "component", "shingles")
    return _in_groups(rows, LEAF).applyInArrow(confirm, "a bigint, b bigint").where("a < b").distinct()


def _with_component(rows: DataFrame, components: DataFrame) -> DataFrame:
    found = components.select(F.col("node").alias("rep"), F.col("component").alias("found"))
    return rows.join(found, "rep", "left").withColumn("component", F.coalesce("found", "rep")).drop("found")


def _part(rep: Column, cell: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(rep, cell), parts)


def _parts(n: Column) -> Column:
    return F.ceil(n / LEAF)


def _dominated(rows: DataFrame) -> DataFrame:
    """Cells in which the classes outside a node's main component meet all of the node, and each other."""
    main, other = rows.where("component = main"), rows.where("component <> main")
    m, u = _parts(F.col("n")), _parts(F.col("n_other"))
    out = ["rep", "signature", "component"]
    own, mine = _part(F.col("rep"), F.col("cell"), m), _part(F.col("rep"), F.col("cell"), u)
    first = main.withColumn("k", F.explode(F.sequence(F.lit(0), u - 1))).select(F.xxhash64("cell", F.lit(0), own, "k").alias("cell"), *out)
    second = other.withColumn("k", F.explode(F.sequence(F.lit(0), m - 1))).select(F.xxhash64("cell", F.lit(0), "k", mine).alias("cell"), *out)
    third = other.withColumn("k", F.explode(F.sequence(F.lit(0), u - 1))).select(
        F.xxhash64("cell", F.lit(1), F.least(mine, F.col("k")), F.greatest(mine, F.col("k"))).alias("cell"), *out
    )
    return first.unionByName(second).unionByName(third)


def _branched(rows: DataFrame) -> DataFrame:
    """A node's children: its path chooses `BRANCHES` signature bytes, whose values part its classes."""
    picks = F.array(*(F.pmod(F.xxhash64("cell", F.lit(k)), F.lit(SIGNATURE)) + 1 for k in range(BRANCHES)))
    picked = rows.withColumn("pick", F.explode(picks))
    value = F.substring(F.col("signature"), F.col("pick").cast("int"), F.lit(1))
    return picked.select(F.xxhash64("cell", "pick", value).alias("cell"), "rep", "signature", "component")


def _walk(rows: DataFrame, n_docs: int) -> DataFrame:
    """The cells to be compared across components, from the roots down."""
    cells = []
    for depth in range(MAX_DEPTH + 1):
        by_component = rows.groupBy("cell", "component").agg(F.count(F.lit(1)).alias("n"))
        sizes = by_component.groupBy("cell").agg(
            F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("components")
        )
        mixed = sizes.where("components > 1").select(
            "cell", "n", F.col("main.component").alias("main"), (F.col("n") - F.col("main.n")).alias("n_other")
        )
        sized = _saved(rows.join(mixed, "cell"), "near-cells", n_docs)
        cells.append(sized.where(F.col("n") <= LEAF).select("cell", "rep", "signature", "component"))
        large = sized.where(F.col("n") > LEAF)
        few = F.lit(True) if depth == MAX_DEPTH else F.col("n_other") <= LEAF
        if large.isEmpty():
            break
        cells.append(_dominated(large.where(few)))
        rows = _branched(large.where(~few))
    out = cells[0]
    for more in cells[1:]:
        out = out.unionByName(more.select(out.columns))
    return out


def _own_id(doc_id: Column, text: Column) -> Column:
    """What stands for a doc_id where its rows have different sets."""
    return F.xxhash64(doc_id.cast("long"), text)


def _with_own_ids(rows: DataFrame, several: DataFrame) -> DataFrame:
    """``rows (doc_id, text)`` with `_own_id` in place of the doc_ids in ``several (s)``, and the true one as ``of``."""
    own = F.when(F.col("s").isNotNull(), _own_id(F.col("doc_id"), F.col("text"))).otherwise(F.col("doc_id"))
    return rows.join(several, F.col("doc_id") == F.col("s"), "left").select(own.alias("doc_id"), "text", F.col("doc_id").alias("of"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least doc_id reachable) and kept (whether that is the row's own).

    Of a doc_id with different sets, one that stands for its component is kept only with the text that does.
    """
    return _judged(docs, doc_id, text, percent).drop("own")


def _judged(docs: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    """`near_duplicates`, with ``own``: the row's `_own_id` where rows of its doc_id have different sets, else null."""
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = materialize(document_sets(named), "near-documents")
    n_docs = sets.count()
    a_set = F.struct("set_a", "set_b", "n_shingles")
    several = sets.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(a_set).alias("x"), F.max(a_set).alias("y"))
    several = _saved(several.where("x <> y").select(F.col("doc_id").alias("s")), "near-several", n_docs)
    if several.isEmpty():
        return _components(named, sets, percent, n_docs).withColumn("own", F.lit(None).cast("long"))
    known = materialize(_with_own_ids(named, several), "near-own-ids")
    found = materialize(_components(known.select("doc_id", "text"), materialize(document_sets(known), "near-documents"), percent, n_docs), "near-own")
    # a component's least true id, and of that id's texts the one that stands for it
    true_ids = known.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("own"), "of").distinct()
    rows = found.join(true_ids, found["doc_id"] == true_ids["own"], "left")
    least = rows.where("own IS NOT NULL").groupBy("component_id").agg(F.min(F.struct("of", "own")).alias("least"))
    least = least.withColumnRenamed("component_id", "c")
    return rows.join(least, F.col("component_id") == F.col("c"), "left").select(
        F.col("of").alias("doc_id"), "n_shingles", F.col("least.of").alias("component_id"),
        F.coalesce(F.col("own") == F.col("least.own"), F.lit(True)).alias("kept"),
        F.when(F.col("own") != F.col("of"), F.col("own")).alias("own"),
    )


def _components(named: DataFrame, sets: DataFrame, percent: int, n_docs: int) -> DataFrame:
    """`near_duplicates` of ``named (doc_id, text)``, whose rows of one doc_id have one set; ``sets`` are their `document_sets`."""
    least = least_matches(percent)
    same = ["set_a", "set_b", "n_shingles"]
    known = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = _saved(
        known.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.first("keys").alias("keys")), "near-classes", n_docs)
    repeated = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("again"))
    repeated = _saved(repeated, "near-repeated", n_docs)
    roots = classes.select("rep", F.explode("keys").alias("cell"))
    sizes = roots.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = roots.join(sizes, "cell")
    rows = _saved(shared.join(classes.select("rep", "signature"), "rep"), "near-roots", n_docs)
    parted = rows.select(
        F.when(F.col("n") <= LEAF, F.col("cell")).otherwise(F.xxhash64("cell", _part(F.col("rep"), F.col("cell"), _parts(F.col("n"))))).alias("cell"),
        "rep", "signature",
    )
    tried = _saved(_proposed(parted, least), "near-tried", n_docs)
    links = _saved(_confirmed(named, repeated, tried, percent, n_docs), "near-links", n_docs)
    components = _saved(connected_components(links.toDF("u", "v")), "near-components", n_docs)
    cells = _saved(_walk(_with_component(rows.select("cell", "rep", "signature"), components), n_docs), "near-leaves", n_docs)
    touched = _saved(_touched(cells, least), "near-touched", n_docs)
    more = _saved(_confirmed_across(named, repeated, touched, least, percent, n_docs), "near-more", n_docs)
    if not more.isEmpty():
        components = _saved(connected_components(links.unionByName(more).toDF("u", "v")), "near-components", n_docs)
    # classes that hold one doc_id are one document, and so are rows of a class
    member = known.select(*same, "doc_id").distinct().join(classes.select(*same, "rep"), same)
    of_id = _with_component(member.select("doc_id", "rep"), components)
    found = of_id.groupBy("doc_id").agg(F.min("component").alias("component"))
    return (
        sets.select("doc_id", "n_shingles")
        .join(found.withColumnRenamed("doc_id", "d"), F.col("doc_id") == F.col("d"), "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
    )


def _one_row(docs: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each value of the keys, the least by a hash of all its columns."""
    fields = [f for f in docs.schema.fields if not isinstance(f.dataType, T.MapType)]
    names = [F.col(f"`{f.name}`") for f in fields]
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(F.min_by(row, F.xxhash64(*names)).alias("__near_row")).select("__near_row.*")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents that stand for their component, with their columns; of repeated rows of one document one stays."""
    judged = materialize(_judged(docs, doc_id, text, percent).where("kept AND doc_id IS NOT NULL").select("doc_id", "own").distinct(), "near-kept")
    known, alone = docs.where(F.col(doc_id).isNotNull()), docs.where(F.col(doc_id).isNull())
    plain = judged.where("own IS NULL").select(F.col("doc_id").alias("__near_id"))
    one = known.join(plain, F.col(doc_id) == F.col("__near_id"), "left_semi")
    one = _one_row(one, [doc_id])
    several = judged.where("own IS NOT NULL").select(F.col("doc_id").alias("__near_id"), F.col("own").alias("__near_own"))
    if several.isEmpty():
        return one.unionByName(alone)
    same = (F.col(doc_id) == F.col("__near_id")) & (_own_id(F.col(doc_id), F.col(text)) == F.col("__near_own"))
    more = _one_row(known.join(several, same, "left_semi"), [doc_id, text])
    return one.unionByName(more).unionByName(alone)
