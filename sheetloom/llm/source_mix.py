"""Mixing sources to target weights by hierarchical budgeting.

Documents hang on a tree of keys, by default domain, language and source.  A
token budget is dealt from the root down: siblings share their parent's budget
by weight, none gets more than it can supply (its tokens times `max_epochs`),
and what one cannot use goes to its siblings by their weights.  As a parent's
capacity is the sum of its children's, a shortage is met among siblings first
and reaches an ancestor's siblings only when all of them are full.

Each leaf then takes as many whole epochs as its budget holds, and of the next
epoch the longest prefix that fits, in the order of a seeded hash.  The prefix
is found as one hash value per leaf: token sums of 4,096 hash ranges point to
the range in which the budget ends, and only that range is ordered by row.
So no task orders a whole leaf.  Documents meet the decisions of their leaf by
broadcast while those take at most `BROADCAST_BYTES`; beyond that each decision
is repeated for the `SALTS` parts into which a leaf's documents are dealt, so no
task reads a whole leaf either way.

Tokens are words.  A null key counts as the empty string, a null text has no
tokens.  Rows with one doc_id share a hash value and are taken or left
together.  Numbers are whole, so a budget is met up to one token for each
sibling and up to the document in which it ends.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetloom.llm.quality_rules import WORD
from sheetloom.session import materialize

RANGE_DIGITS = 3  # hexadecimal digits of the hash that number its range
WIDE = "decimal(38,0)"
SEPARATOR = "\x1f"
BROADCAST_BYTES = 8 << 20  # keys and numbers of all leaves
LEAF_BYTES = 128  # of one leaf, next to its keys
SALTS = 32

Weights = Mapping[tuple[str, ...], int]


def _weight(weights: Weights, path: list[Column]) -> Column:
    """The weight of a node, 1 if none is given."""
    own = {k: v for k, v in weights.items() if len(k) == len(path)}
    if not own:
        return F.lit(1).cast(WIDE)
    table = F.create_map(*(F.lit(x) for k, v in own.items() for x in (SEPARATOR.join(k), v)))
    return F.coalesce(F.try_element_at(table, F.concat_ws(SEPARATOR, *path)), F.lit(1)).cast(WIDE)


def deal(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Deal ``budget`` among the siblings of each parent: adds ``share``.

    `nodes` has the parents' columns, `name`, ``capacity``, ``weight`` and
    ``budget`` (the parent's).  Siblings are gone through by capacity for each
    unit of weight; while one's fair part of what is left exceeds its capacity
    it is full.
    """
    family = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = family.orderBy(F.col("capacity").cast("double") / F.col("weight").cast("double"), F.col(name))
    earlier = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(WIDE)
    left = nodes.where("weight > 0").withColumns(
        {
            "rest": (F.col("budget") - earlier).cast(WIDE),
            "open": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).cast(WIDE),
        }
    )
    full = F.col("capacity") * F.col("open") <= F.col("rest") * F.col("weight")
    marked = left.withColumn("full", full)
    return (
        marked.withColumns({"rest": F.max(F.expr("CASE WHEN NOT full THEN rest END")).over(family), "open": F.max(F.expr("CASE WHEN NOT full THEN open END")).over(family)})
        .withColumn("share", F.when(F.col("full"), F.col("capacity")).otherwise(F.expr("(rest * weight) div open")).cast(WIDE))
        .drop("rest", "open", "full")
    )


def _meet(rows: DataFrame, leaves: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """`rows` next to the row of their leaf; `leaves` is a written table, `spread` are columns that tell rows apart."""
    size = leaves.agg(F.sum(F.lit(LEAF_BYTES) + sum((F.octet_length(F.col(k)) for k in keys), F.lit(0)))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(leaves), keys)
    parts = leaves.withColumn("__mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("__mix_salt", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in spread)), F.lit(SALTS)).cast("int"))
    return salted.join(parts, [*keys, "__mix_salt"]).drop("__mix_salt")


def leaf_budgets(leaves: DataFrame, keys: list[str], weights: Weights, percent: int, max_epochs: int, budget: int | None = None) -> DataFrame:
    """``share`` of every leaf of ``leaves (keys..., tokens)``; the whole budget is `budget` or `percent` of all tokens."""
    capacity = (F.sum("tokens") * max_epochs).cast(WIDE)
    top = leaves.agg((F.coalesce(F.sum("tokens"), F.lit(0)).cast(WIDE) * percent / 100).alias("budget"))
    whole = top.select((F.floor("budget") if budget is None else F.lit(budget)).cast(WIDE).alias("budget"))
    dealt = None
    for depth in range(1, len(keys) + 1):
        path = keys[:depth]
        nodes = leaves.groupBy(*path).agg(capacity.alias("capacity")).withColumn("weight", _weight(weights, [F.col(k) for k in path]))
        # the root's budget is one row; deeper budgets come by the parent's key
        nodes = nodes.join(F.broadcast(whole)) if dealt is None else nodes.join(dealt, path[:-1])
        dealt = deal(nodes, path[:-1], path[-1]).select(*path, F.col("share").alias("budget"))
    return dealt.withColumnRenamed("budget", "share")


def plan_mix(
    counted: DataFrame,
    keys: list[str],
    weights: Weights,
    percent: int = 50,
    max_epochs: int = 1,
    seed: int = 0,
    budget: int | None = None,
) -> DataFrame:
    """One row for each leaf of ``counted (keys..., doc_id, tokens)``: ``epochs`` and ``last``, as a written table.

    A document is taken ``epochs`` times, and once more if its hash for the
    next epoch is not above ``last``.
    """
    leaves = materialize(counted.groupBy(*keys).agg(F.sum("tokens").cast("long").alias("tokens")), "mix-leaves")
    shares = leaf_budgets(leaves, keys, weights, percent, max_epochs, budget)
    begun = leaves.join(shares, keys, "left").select(
        *keys,
        F.when(F.col("tokens") > 0, F.expr("coalesce(share, 0) div tokens")).otherwise(0).cast("long").alias("epochs"),
        F.when(F.col("tokens") > 0, F.expr("coalesce(share, 0) % tokens")).otherwise(0).cast("long").alias("rest"),
    )
    begun = materialize(begun, "mix-epochs")
    hashed = _meet(counted, begun, keys, ["doc_id", "tokens"]).select(*keys, "tokens", "rest", document_hash(seed).alias("hash"))
    ranges = hashed.groupBy(*keys, "rest", F.substring("hash", 1, RANGE_DIGITS).alias("range")).agg(F.sum("tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy(*keys).orderBy("range"))
    # the first range that does not fit whole; a leaf all of whose ranges fit takes everything
    ends = (
        ranges.withColumn("upto", upto)
        .where("upto > rest")
        .groupBy(*keys)
        .agg(F.min("range").alias("range"), F.min(F.struct("range", (F.col("upto") - F.col("tokens")).alias("before")))["before"].alias("before"))
    )
    ends = materialize(ends, "mix-ends")
    inside = _meet(hashed, ends, keys, ["hash", "tokens"]).where(F.substring("hash", 1, RANGE_DIGITS) == F.col("range"))
    inside = inside.groupBy(*keys, "hash", "rest", "before").agg(F.sum("tokens").alias("tokens"))
    fits = F.col("before") + F.sum("tokens").over(Window.partitionBy(*keys).orderBy("hash"))
    last = inside.withColumn("fits", fits <= F.col("rest")).where("fits").groupBy(*keys).agg(F.max("hash").alias("hash"))
    plan = (
        begun.join(ends, keys, "left")
        .join(last, keys, "left")
        # nothing of the range fits: everything below the range; no range cuts: everything
        .select(*keys, "epochs", F.coalesce("hash", "range", F.when(F.col("rest") >= 0, F.lit("g"))).alias("last"))
    )
    return materialize(plan, "mix-plan")


def document_hash(seed: int) -> Column:
    """The place of a document in its next epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.col("doc_id").cast("string")))


def copies(seed: int) -> Column:
    """How often a document is taken, next to the columns of `plan_mix`."""
    return (F.col("epochs") + F.when(document_hash(seed) <= F.col("last"), 1).otherwise(0)).cast("long")


def _counted(docs: DataFrame, keys: Mapping[str, Column], doc_id: str, text: str) -> DataFrame:
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))
    named = docs.select(
        *(F.coalesce(c.cast("string"), F.lit("")).alias(k) for k, c in keys.items()), F.col(doc_id).alias("doc_id"), F.size(words).cast("long").alias("tokens")
    )
    return materialize(named, "mix-counted")


def mix_report(docs: DataFrame, keys: Mapping[str, Column], weights: Weights, doc_id: str = "doc_id", text: str = "text", seed: int = 0, **options) -> DataFrame:
    """Per row: doc_id, its keys, its tokens and ``n_copies`` (0: left out)."""
    counted = _counted(docs, keys, doc_id, text)
    plan = plan_mix(counted, list(keys), weights, seed=seed, **options)
    return _meet(counted, plan, list(keys), ["doc_id", "tokens"]).select("doc_id", *keys, F.col("tokens").alias("n_tokens"), copies(seed).alias("n_copies"))


def mix_documents(docs: DataFrame, keys: Mapping[str, Column], weights: Weights, doc_id: str = "doc_id", text: str = "text", seed: int = 0, **options) -> DataFrame:
    """The mixed documents with their columns, each as often as it is taken."""
    own = {f"__mix_{k}": c for k, c in keys.items()}
    counted = _counted(docs, own, doc_id, text)
    plan = plan_mix(counted, list(own), weights, seed=seed, **options)
    plan = plan.withColumnsRenamed({"epochs": "__mix_epochs", "last": "__mix_last"})
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__mix_epochs").cast("string"), F.col(doc_id).cast("string")))
    named = docs.withColumns({k: F.coalesce(c.cast("string"), F.lit("")) for k, c in own.items()})
    taken = _meet(named, plan, list(own), [doc_id, text]).withColumn(
        "__mix_copies", (F.col("__mix_epochs") + F.when(place <= F.col("__mix_last"), 1).otherwise(0)).cast("int")
    )
    many = taken.where("__mix_copies > 0").withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies"))))
    return many.select(*(F.col(f"`{c}`") for c in docs.columns))
