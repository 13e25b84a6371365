"""A Merkle manifest of a table: leaves by row, a subroot by group, one root, and each leaf's proof.

Digests are hex texts of SHA-256. Of a group's leaves in order every run of ``FANOUT`` becomes one node,
until one node is left; subroots in order of their groups become the root likewise.

The tree is hashed by supersteps over an RDD whose vertices are subtrees of ``span`` levels: children
message their digests to the parent vertex, which hashes once it has heard all of them and messages on.
Reverse supersteps send the siblings along the path from the root down to the vertices, and from there
to the leaves. A vertex has at most ``FANOUT ** span`` children, whatever the group's size, so that a
group with most of the rows is many vertices' work. Leaves are placed by a range sort and counts by
partition; the driver sees the height only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import shared_dir, written

FANOUT = 3
#: levels of one vertex
SPAN = 5


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """The digest of a row's fields: each ``-`` if null, else its byte count, a colon and its value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


# ---- one vertex: a subtree over consecutive nodes --------------------------------------------------------------------


def levels(nodes: list[str], in_level: int, span: int) -> list[list[str]]:
    """The nodes of a vertex level by level. ``in_level`` counts the nodes of the whole group's lowest level; there are
    no levels above the one that has a single node."""
    out = [nodes]
    while len(out) <= span and in_level > 1:
        last = out[-1]
        out.append([digest(last[k : k + FANOUT]) for k in range(0, len(last), FANOUT)])
        in_level = -(-in_level // FANOUT)
    return out


def siblings(rows: list[list[str]], at: int) -> list[tuple[int, tuple[str, ...]]]:
    """Level by level from the node ``at`` of the lowest one: its place in its run, and the run's others."""
    out = []
    for row in rows[:-1]:
        run = at - at % FANOUT
        out.append((at - run, tuple(x for k, x in enumerate(row[run : run + FANOUT], run) if k != at)))
        at //= FANOUT
    return out


def fold(node: str, path: list[tuple[int, tuple[str, ...]]]) -> str:
    """The top that a node and the siblings on its path give."""
    for place, others in path:
        node = digest([*others[:place], node, *others[place:]])
    return node


# ---- supersteps ------------------------------------------------------------------------------------------------------


def _height(n: int) -> int:
    """Levels above n leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // FANOUT), h + 1
    return h


def ascend(vertices: RDD, height: int, span: int, parts: int) -> tuple[list[RDD], RDD]:
    """Upward supersteps from ((group, block), (nodes in the group's level, digests)): the vertices of every superstep, and
    (group, top). A vertex that holds its group's top messages no more; the others go on."""
    width, steps, tops = FANOUT**span, [vertices], []

    def send(item: tuple) -> tuple:
        (group, block), (in_level, nodes) = item
        (top,) = levels(nodes, in_level, span)[-1]
        for _ in range(span):
            in_level = -(-in_level // FANOUT)
        return group, block, in_level, top

    def receive(item: tuple) -> tuple:
        (group, block), messages = item
        heard = sorted(messages)
        in_level = heard[0][1]
        if len(heard) != min(width, in_level - block * width):
            raise ValueError(f"vertex {group}, {block} has heard {len(heard)} of its children")
        return (group, block), (in_level, [node for _, _, node in heard])

    while True:
        sent = steps[-1].map(send)
        tops.append(sent.filter(lambda x: x[2] <= 1).map(lambda x: (x[0], x[3])))
        height -= span
        if height <= 0:
            break
        heard = sent.filter(lambda x: x[2] > 1).map(lambda x: ((x[0], x[1] // width), (x[1] % width, x[2], x[3]))).groupByKey(parts).map(receive)
        heard.checkpoint()
        steps.append(heard)
    return steps, reduce(lambda a, b: a.union(b), tops)


def descend(steps: list[RDD], tops: RDD, span: int, parts: int) -> RDD:
    """Reverse supersteps: ((group, block), path from the lowest vertex's top to the root) of every lowest vertex.
    ``tops`` has (group, path from the group's top to the root)."""
    width = FANOUT**span
    down: RDD | None = None
    for k in range(len(steps) - 1, -1, -1):
        # a vertex that holds its group's top hears from the root, any other from its parent vertex
        held = steps[k].filter(lambda x: x[1][0] <= width)
        heard = held.map(lambda x: (x[0][0], x[0][1])).join(tops, parts).map(lambda x: ((x[0], x[1][0]), x[1][1]))
        down = heard if down is None else heard.union(down)
        if k == 0:
            return down

        def tell(item: tuple) -> Iterator[tuple]:
            (group, block), ((in_level, nodes), path) = item
            rows = levels(nodes, in_level, span)
            for at in range(len(nodes)):
                yield (group, block * width + at), [*siblings(rows, at), *path]

        down = steps[k].join(down, parts).flatMap(tell)
    raise ValueError("no superstep")


# ---- places of leaves ------------------------------------------------------------------------------------------------


def placed(rows: DataFrame, group: str, order: list[str], parts: int) -> tuple[DataFrame, DataFrame]:
    """The rows with ``sid`` (number of the group, in order of its value, null first) and ``pos`` (place in it), both from
    0, and the groups with ``sid`` and ``n``. Rows are sorted by range and numbered where they lie; offsets come from
    counts by partition and group. One window runs over the partitions' counts, which grow with the partitions only."""
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    at = (F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("_i")
    lying = written(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("_part"), at), "leaves")
    counts = lying.groupBy("_part", F.col(group).alias("_group")).agg(F.count("*").alias("_c"), F.min("_i").alias("_low"))
    own = Window.partitionBy("_group")
    before = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("*", F.sum("_c").over(own).alias("n"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"), (F.min("_part").over(own)).alias("_first"))
    counts = written(counts, "places")
    opens = counts.where("_part = _first")
    local = opens.select("_group", "n", "_part", F.row_number().over(Window.partitionBy("_part").orderBy(F.col("_group").asc_nulls_first())).alias("_k"))
    bases = opens.groupBy("_part").count()
    bases = bases.select(F.col("_part").alias("_p"), (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_base"))
    groups = written(local.join(bases, F.col("_part") == F.col("_p")).select("_group", "n", (F.col("_base") + F.col("_k") - 1).alias("sid")), "groups")
    spots = counts.join(groups.select(F.col("_group").alias("_g"), "sid"), F.col("_group").eqNullSafe(F.col("_g"))).select(F.col("_part").alias("_p"), F.col("_group").alias("_g"), "n", "sid", "_low", "_off")
    put = lying.join(spots, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return put.select(*rows.columns, "sid", "n", (F.col("_i") - F.col("_low") + F.col("_off")).alias("pos")), groups


# ---- the manifest ----------------------------------------------------------------------------------------------------


def manifest(docs: DataFrame, fields: list[str], *, group: str, order: str, text: str, tampered: Column | None = None, span: int = SPAN) -> DataFrame:
    """Per row of ``docs``: ``order``'s value, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (of the siblings' digests
    from the leaf to the root), ``folded_root`` (what the leaf, from ``tampered`` in place of ``text`` where given, and
    these siblings give) and ``verified``.

    Leaves of a group ascend by ``order``, null first, and by digest where they tie; repeated rows are leaves of their
    own. Null fields count as such, and differ from empty ones. Null groups are one group, the first. An empty table
    gives an empty manifest. Other columns are left out, whatever their names. Long texts are hashed whole, before any
    shuffle; only digests are moved.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = FANOUT**span
    false = [tampered if c == text and tampered is not None else F.col(c) for c in fields]
    leaves = docs.select(F.col(group).alias("grp"), F.col(order).alias("key"), leaf(*map(F.col, fields)).alias("leaf"), leaf(*false).alias("found"))
    rows, groups = placed(leaves, "grp", ["key", "leaf", "found"], parts)
    block = F.floor(F.col("pos") / width)
    lowest = rows.groupBy("sid", block.alias("block")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "key", "leaf", "found"))).alias("own"))
    lowest = written(lowest, "vertices")
    most, many = groups.agg(F.max("n"), F.count("*")).first()
    kind = docs.schema[order].dataType.simpleString()
    schema = f"`{order}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if not many:
        return spark.createDataFrame([], schema)
    vertices = lowest.select("sid", "block", "n", F.col("own.leaf").alias("nodes")).rdd.map(lambda x: ((x.sid, x.block), (x.n, x.nodes)))
    steps, subroots = ascend(vertices, _height(most), span, parts)
    subroots.checkpoint()
    # the groups' tops are the leaves of one more tree, whose group is 0
    upper = subroots.map(lambda x: ((0, x[0] // width), (x[0] % width, x[1]))).groupByKey(parts).map(lambda x: (x[0], (many, [node for _, node in sorted(x[1])])))
    upper_steps, tops = ascend(upper, _height(many), span, parts)
    upper_down = descend(upper_steps, tops.map(lambda x: (x[0], [])), span, parts)

    def tell_groups(item: tuple) -> Iterator[tuple]:
        (_, at_block), ((in_level, nodes), path) = item
        inner = levels(nodes, in_level, span)
        for at, node in enumerate(nodes):
            full = [*siblings(inner, at), *path]
            yield at_block * width + at, (node, fold(node, full), full)

    ends = upper.join(upper_down, parts).flatMap(tell_groups)  # (sid, (subroot, root, path from the one to the other))
    ends.checkpoint()
    paths = descend(steps, ends.map(lambda x: (x[0], [x[1]])), span, parts)

    def tell_leaves(item: tuple) -> Iterator[tuple]:
        _, ((in_level, own), path) = item
        *inside, (subroot, root, above) = path
        inner = levels([o.leaf for o in own], in_level, span)
        for at, o in enumerate(own):
            full = [*siblings(inner, at), *inside, *above]
            folded = fold(o.found, full)
            yield o.key, o.leaf, subroot, root, digest([x for _, others in full for x in others]), folded, folded == root

    told = lowest.rdd.map(lambda x: ((x.sid, x.block), (x.n, x.own))).join(paths, parts).flatMap(tell_leaves)
    return spark.createDataFrame(told, schema)


def document_manifest(docs: DataFrame, *, span: int = SPAN) -> DataFrame:
    """The manifest of ``documents`` by source. Copies to be verified are tampered with where 2 divides the CRC-32 of the
    id in decimal: their texts lose all line feeds (null texts and rows without an id stay)."""
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    tampered = F.when(odd == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], group="source", order="doc_id", text="text", tampered=tampered, span=span)
