"""A Merkle manifest of a table: one tree a group, one tree over the groups.

Leaves are digests of whole rows. A group's leaves ascend by id; their places come from
one range partitioning by (group, id), whose partitions each count their own rows, so a
group that holds most rows is spread like any other.

Up. Nodes of one level are grouped by their parent, and conditional aggregates spread the
children into ``fanout`` slot columns (the slot pivot). Hashing the concatenated columns
gives the next level, leaving a slot's own column out gives that child's siblings. A level
is a written table a ``fanout``-th the size of the last; groups whose node is the only
one leave as subroots.

Down. A parent's proof, the digests beside the path, goes to its children with their
siblings put before it. It meets the pivoted row of a parent, not its children, and the
lowest pivot holds the leaves' own columns, so no row is looked up twice: all levels
together move about two proofs for each ``fanout`` leaves. Digests travel as 32 bytes.

Digests. H is sha256 in lowercase hex of the concatenated inputs, digests as hex text. A
leaf's inputs are the chosen columns, ``-`` if null, else UTF-8 byte count, colon, value.

Choices: null ids come first in a group, equal ids go by digest; repeated rows are leaves of
their own. A group with one leaf has it as its subroot, a single subroot is the root, and a
proof without siblings is H of the empty text. Null groups come first, others by their
UTF-8 bytes. An empty table gives no rows. Only the id, group and leaf columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tauframe.llm.storage import checkpoint

#: Digests beside a node on its way up: those left of it and those right of it, a level each.
PROOF = "array<struct<before: binary, after: binary>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _hex(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def field_text(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    return digest(F.concat(*[field_text(c) for c in columns]))


def _placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``pos`` from 0 inside its ``group``, along ``order``, and the group's size ``n``.

    Rows get their index in a sorted range partition; what is added per partition and
    group is a table of at most partitions plus groups rows.
    """
    tied = checkpoint(nodes.withColumn("_tie", F.monotonically_increasing_id()))
    sort = [F.col("group").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col("_tie")]
    index = F.monotonically_increasing_id()
    ranged = checkpoint(tied.repartitionByRange(*sort).sortWithinPartitions(*sort).drop("_tie").withColumn("_at", index).select(
        "*", F.shiftright("_at", 33).alias("_part")))
    runs = ranged.groupBy("group", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy("group")
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        F.col("group").alias("_g"), F.col("_part").alias("_p"),
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(whole).alias("n"))
    same = ranged["group"].eqNullSafe(starts["_g"]) & (ranged["_part"] == starts["_p"])
    return ranged.join(starts, same).withColumn("pos", F.col("_at") + F.col("_shift")).drop(
        "_at", "_part", "_g", "_p", "_shift")


def _pivot(nodes: DataFrame, fanout: int, keep: list[str]) -> DataFrame:
    """One row a parent: its children's ``hash`` and ``keep`` columns in slot columns."""
    slot = F.pmod("pos", F.lit(fanout))
    cells = [
        F.max(F.when(slot == i, F.struct("hash", *keep))).alias(f"c{i}") for i in range(fanout)]
    return nodes.groupBy("group", F.floor(F.col("pos") / fanout).cast("long").alias("pos"), "n").agg(*cells)


def _joined(fanout: int, own: int | None = None) -> Column:
    """Digests of all slots but ``own`` as one text."""
    return F.concat(*[
        F.coalesce(_hex(F.col(f"c{i}.hash")), F.lit("")) for i in range(fanout) if i != own])


def _side(slots: range) -> Column:
    """Digests of a run of slots as bytes, empty slots left out."""
    empty = F.lit(b"")
    return F.concat(*[F.coalesce(F.col(f"c{i}.hash"), empty) for i in slots]) if len(slots) else empty


def _children(pivoted: DataFrame, fanout: int, keep: list[str]) -> DataFrame:
    """The children of parents with a ``proof`` and ``subroot``, each with its own proof."""
    rows = []
    for i in range(fanout):
        step = F.struct(_side(range(i)).alias("before"), _side(range(i + 1, fanout)).alias("after"))
        rows.append(F.when(F.col(f"c{i}").isNotNull(), F.struct(
            (F.col("pos") * fanout + i).alias("pos"), F.col(f"c{i}.hash").alias("hash"),
            *[F.col(f"c{i}")[k].alias(k) for k in keep],
            F.concat(F.array(step), F.col("proof")).cast(PROOF).alias("proof"))))
    return pivoted.select("group", "subroot", F.explode(F.array_compact(F.array(*rows))).alias("r")).select(
        "group", "subroot", "r.*")


def _tree(leaves: DataFrame, fanout: int, keep: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """(the pivoted levels, lowest first; one row a group with its root ``hash`` and ``height``).

    ``leaves`` has group, pos, n, hash and the ``keep`` columns. A level holds the groups
    that still had several nodes below it.
    """
    alone = leaves.filter("n = 1").select("group", "hash", F.lit(0).alias("height"))
    largest = leaves.agg(F.max("n")).first()[0] or 0
    levels: list[DataFrame] = []
    nodes = leaves.filter("n > 1")
    while largest > 1:
        pivoted = checkpoint(_pivot(nodes, fanout, keep if not levels else []))
        levels.append(pivoted)
        nodes = pivoted.select(
            "group", "pos", F.ceil(F.col("n") / fanout).cast("long").alias("n"),
            F.unhex(digest(_joined(fanout))).alias("hash"))
        alone = alone.unionByName(nodes.filter("n = 1").select("group", "hash", F.lit(len(levels)).alias("height")))
        nodes = nodes.filter("n > 1")
        largest = -(-largest // fanout)
    return levels, checkpoint(alone)


def _proofs(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, fanout: int, keep: list[str]) -> DataFrame:
    """Every leaf with ``proof`` and ``subroot``; ``tops`` has group, height, proof, subroot."""
    known = None
    for height in range(len(levels), 0, -1):
        start = tops.filter(F.col("height") == height).select("group", F.lit(0).cast("long").alias("pos"), "proof", "subroot")
        above = start if known is None else start.unionByName(known.select("group", "pos", "proof", "subroot"))
        above = above.withColumnsRenamed({"group": "_g", "pos": "_p"})
        level = levels[height - 1]
        met = level.join(above, level["group"].eqNullSafe(above["_g"]) & (level["pos"] == above["_p"]))
        known = _children(met, fanout, keep if height == 1 else [])
        if height > 1:
            known = checkpoint(known)
    single = tops.filter("height = 0").select(F.col("group").alias("_g"), "proof", "subroot")
    lone = leaves.filter("n = 1").join(single, F.col("group").eqNullSafe(F.col("_g"))).select(
        "group", "subroot", F.lit(0).cast("long").alias("pos"), "hash", *keep, "proof")
    return lone if known is None else known.unionByName(lone)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's hex digest and its proof give."""
    return F.aggregate(proof, leaf, lambda own, level: digest(
        F.concat(_hex(level["before"]), own, _hex(level["after"]))))


def proof_digest(proof: Column) -> Column:
    """H of a proof's siblings, level by level, left to right."""
    return digest(F.concat_ws("", F.transform(
        proof, lambda level: F.concat(_hex(level["before"]), _hex(level["after"])))))


def manifest(leaves: DataFrame, fanout: int = 2, carry: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """One row per leaf: group, id, leaf, subroot, root, proof and the ``carry`` columns.

    ``leaves`` has group, id, leaf (hex) and the ``carry`` columns. ``leaf``, ``subroot`` and
    ``root`` come as hex, ``proof`` as bytes a level.
    """
    keep = ["id", *carry]
    rows = leaves.select("group", F.unhex("leaf").alias("hash"), *keep)
    placed = checkpoint(_placed(rows, ["id", "hash"]))
    levels, roots = _tree(placed, fanout, keep)

    # The groups are the leaves of a tree of their own, whose only group is null.
    order = F.col("group").cast("binary")
    upper = _placed(roots.select(
        F.lit(None).cast("string").alias("group"), order.alias("_order"), "hash", "height",
        F.col("group").alias("name")), ["_order"]).drop("_order")
    upper = checkpoint(upper)
    upper_levels, top = _tree(upper, fanout, ["height", "name"])
    top = checkpoint(top.select("group", "height", F.expr(f"cast(array() AS {PROOF})").alias("proof"), F.col("hash").alias("subroot")))
    proved = _proofs(upper, upper_levels, top, fanout, ["height", "name"])
    tops = checkpoint(proved.select(
        F.col("name").alias("group"), "height", "proof", F.struct(F.col("hash").alias("own"), F.col("subroot").alias("root")).alias("subroot")))
    return _proofs(placed, levels, tops, fanout, keep).select(
        "group", *keep, _hex(F.col("hash")).alias("leaf"), _hex(F.col("subroot.own")).alias("subroot"),
        _hex(F.col("subroot.root")).alias("root"), "proof")
