"""Prefixes that conversations share, as nodes of a burst trie.

Each distinct turn has an id, the digest of its role and text; the key of a prefix is the digest of its
parent's key and its last turn's id. A conversation is the string of its keys, so two of them
agree in their first ``16 * d`` bytes if and only if they share ``d`` turns.

*Bursting.* The root is a trie head over one container, which holds the suffixes of all
conversations. The container of a prefix is oversized when two conversations or more hold more turns
in it than a bound; it is then burst: its prefix becomes a head, and its suffixes go to containers of
their next turn. A round counts the containers of the next few levels of all oversized ones in one
grouped aggregate, and the number of levels doubles, so rounds grow with the logarithm of the depth.

*Sweeping.* What remains is dealt to shards by container and sorted by key string; a task sweeps the
sorted suffixes with a stack of open nodes. Members of a node arrive in a row and by number, so their
digest is carried along, and a finished container leaves as nodes. The heads add up what their
containers and the heads below them bring. Members that end at a head, of which there may be any
number, are joined to pieces by range before one stream takes their digest.

A conversation is one string of 16 bytes a turn and must fit in a task.

Cases: a null role or text is empty. Null turn numbers come first; equal ones are ordered by the turn's
id. A row with a null conversation id belongs to no conversation. Conversations without turns are
members of the root alone. Repeated rows are turns of their own. An empty table gives no rows. Columns
other than the four named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelshift.functions.joins import BROADCAST_ROWS

from .book import query, table
from .storage import stored

KEY = 16
FAMILY = 5
HEADS = 9
LEAST_TURNS = 2_000
SHARES = 100_000
PIECE_ROWS = 20_000


def turns_of(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """conv_id and its turns in order: an array of (id, bytes of the text)."""
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    place = F.struct(
        F.col(turn_col).isNotNull().alias("numbered"),
        F.col(turn_col).alias("turn"),
        digest.alias("id"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    named = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), place.alias("t"))
    return named.groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t.id.alias("id"), t.bytes.alias("bytes"))).alias("turns")
    )


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Each conversation with its first turns replaced by those of its family's first member."""
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    kept = conversations.select("conv_id", "turns", first.alias("family"), shared.alias("h"))
    heads = conversations.select(F.col("conv_id").alias("family"), F.slice("turns", 1, HEADS - 1).alias("base"))
    begin = F.coalesce(F.expr("slice(base, 1, h)"), F.expr("slice(turns, 1, 0)"))
    return kept.join(heads, "family", "left").select(
        "conv_id", F.concat(begin, F.expr("slice(turns, h + 1, size(turns))")).alias("turns")
    )


def keyed(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, keys (one for each prefix, joined) and sizes (bytes of each turn's text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lengths = [], []
            for ids in batch.column(1).to_pylist():
                key, own = b"", []
                for turn in ids:
                    key = hashlib.md5(key + turn, usedforsecurity=False).digest()
                    own.append(key)
                keys.append(b"".join(own))
                lengths.append(len(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int32()), pa.array(keys, pa.binary()), batch.column(2)],
                ["conv_id", "n_turns", "keys", "sizes"],
            )

    chosen = conversations.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.bytes").alias("sizes"))
    return chosen.mapInArrow(run, "conv_id long, n_turns int, keys binary, sizes array<long>")


def _key(depth: str) -> str:
    return f"substring(keys, {KEY} * ({depth}) - {KEY - 1}, {KEY})"


def _path(depth: str) -> str:
    return f"substring(keys, 1, {KEY} * ({depth}))"


def burst(members: DataFrame, least_turns: int = LEAST_TURNS, shares: int = SHARES) -> tuple[DataFrame, DataFrame]:
    """Members with ``reach``, the depth of the last head on their path, and the heads below the root.

    A container with more turns than ``least_turns`` and than a ``shares``-th of all is oversized. Heads
    have key, depth, path, n_convs, conv_id (least member) and bytes of their last turn.
    """
    total = members.agg(F.coalesce(F.sum("n_turns"), F.lit(0))).first()[0]
    limit = max(least_turns, total // shares)
    opened = members.withColumn("reach", F.lit(0))
    settled, heads = [], []
    depth, levels = 0, 1
    while True:
        inside = opened.where(F.col("n_turns") > depth)
        settled.append(opened.where(F.col("n_turns") <= depth))
        level = F.explode(F.expr(f"sequence({depth + 1}, least({depth + levels}, n_turns))")).alias("depth")
        steps = inside.select("conv_id", "n_turns", "keys", "sizes", level)
        found = (
            steps.select(
                F.expr(_key("depth")).alias("key"),
                "depth",
                "conv_id",
                F.struct(F.expr(_path("depth")).alias("path"), F.expr("sizes[depth - 1]").alias("bytes")).alias("facts"),
                (F.col("n_turns") - F.col("depth") + 1).cast("long").alias("held"),
            )
            .groupBy("key", "depth")
            .agg(
                F.count(F.lit(1)).alias("n_convs"),
                F.min("conv_id").alias("conv_id"),
                F.sum("held").alias("held"),
                F.first("facts").alias("facts"),
            )
            .where((F.col("n_convs") > 1) & (F.col("held") > limit))
            .select("key", "depth", "facts.path", "n_convs", "conv_id", "facts.bytes")
        )
        found = stored(found)
        if found.isEmpty():
            settled.append(inside)
            break
        heads.append(found)
        known = found.select("key")
        if found.count() <= BROADCAST_ROWS:
            known = F.broadcast(known)
        # Heads on a path follow each other, so their number is how far it has been burst.
        passed = (
            steps.select("conv_id", F.expr(_key("depth")).alias("key"))
            .join(known, "key", "left_semi")
            .groupBy("conv_id")
            .agg(F.count(F.lit(1)).cast("int").alias("passed"))
        )
        moved = stored(
            inside.join(passed, "conv_id", "left")
            .withColumn("reach", F.lit(depth) + F.coalesce("passed", F.lit(0)))
            .drop("passed")
        )
        depth, levels = depth + levels, levels * 2
        settled.append(moved.where(F.col("reach") < depth))
        opened = moved.where(F.col("reach") == depth)
    everything = settled[0]
    for part in settled[1:]:
        everything = everything.unionByName(part)
    if not heads:
        return everything, members.sparkSession.createDataFrame(
            [], "key binary, depth int, path binary, n_convs long, conv_id long, bytes long"
        )
    tops = heads[0]
    for part in heads[1:]:
        tops = tops.unionAll(part)
    return everything, tops


class _Node:
    """An open node of the sweep; rows of its children wait for its least member."""

    __slots__ = ("bytes", "children", "depth", "ends", "key", "least", "leaves", "n", "saved", "waiting")

    def __init__(self, depth: int, key: bytes, size: int):
        self.depth, self.key, self.bytes = depth, key, size
        self.least: int | None = None
        self.n = self.children = self.leaves = self.saved = 0
        self.ends = None
        self.waiting: list[list] = []

    def end(self, conv_id: int) -> None:
        self.n += 1
        self.least = conv_id if self.least is None else min(self.least, conv_id)
        if self.ends is None:
            self.ends = hashlib.sha256(str(conv_id).encode())
        else:
            self.ends.update(b",%d" % conv_id)


EMPTY = hashlib.sha256(b"").hexdigest()
NODES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long,"
    " saved_tokens long, ends_sha256 string, path binary"
)
_NODE_KINDS = [pa.int64()] * 7 + [pa.string(), pa.binary()]
_NODE_NAMES = [part.split()[0] for part in NODES.split(", ")]


def sweep(rows: Iterator[tuple[int, bytes, list[int], int]]) -> Iterator[list]:
    """Node rows of containers, from (conv_id, keys, sizes, reach) sorted by keys and conv_id.

    The top of a container has no parent here; its ``path``, the keys of the heads above, tells where it
    hangs. Other nodes have an empty path.
    """
    stack: list[_Node] = []
    before, reach = b"", 0

    def close() -> Iterator[list]:
        node = stack.pop()
        node.leaves = node.leaves or 1
        node.saved += (node.n - 1) * node.bytes
        for row in node.waiting:
            row[2] = node.least
            yield row
        ends = EMPTY if node.ends is None else node.ends.hexdigest()
        own = [node.least, node.depth, None, node.n, node.children, node.leaves, node.saved, ends, None]
        if not stack:
            own[8] = before[: KEY * reach]
            yield own
            return
        above = stack[-1]
        above.n += node.n
        above.least = node.least if above.least is None else min(above.least, node.least)
        above.children += 1
        above.leaves += node.leaves
        above.saved += node.saved
        above.waiting.append(own)

    for conv_id, keys, sizes, at in rows:
        while stack and keys[KEY * (stack[-1].depth - 1) : KEY * stack[-1].depth] != stack[-1].key:
            yield from close()
        before, reach = keys, at
        for depth in range((stack[-1].depth if stack else at) + 1, len(sizes) + 1):
            stack.append(_Node(depth, keys[KEY * (depth - 1) : KEY * depth], sizes[depth - 1]))
        stack[-1].end(conv_id)
    while stack:
        yield from close()


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True)

    made: list[list] = []

    def batch() -> pa.RecordBatch:
        columns = zip(*made, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, _NODE_KINDS, strict=True)], _NODE_NAMES
        )

    for row in sweep(rows()):
        made.append(row)
        if len(made) >= PIECE_ROWS:
            yield batch()
            made = []
    if made:
        yield batch()


def ends_digests(ends: DataFrame) -> DataFrame:
    """key and the digest of its members' ids, ascending; ids are joined by range first."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            rows = [
                (keys[a], ids[a], ",".join(map(str, ids[a:b])))
                for a, b in zip(cuts, cuts[1:])
                if a < b
            ]
            if rows:
                columns = zip(*rows, strict=True)
                kinds = [pa.binary(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "first", "ids"]
                )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"]
            )

        for batch in batches:
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if state is None or own != key:
                    if state is not None:
                        yield done()
                    key, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if state is not None:
            yield done()

    joined = (
        ends.repartitionByRange("key", "conv_id")
        .sortWithinPartitions("key", "conv_id")
        .mapInArrow(pieces, "key binary, first long, ids string")
    )
    return (
        stored(joined)
        .repartition("key")
        .sortWithinPartitions("key", "first")
        .mapInArrow(digests, "key binary, ends_sha256 string")
    )


def trie_nodes(conversations: DataFrame, least_turns: int = LEAST_TURNS, shares: int = SHARES) -> DataFrame:
    """Every distinct prefix of the conversations (conv_id, turns) as a node."""
    members = stored(keyed(conversations))
    placed, heads = burst(members, least_turns, shares)
    root = members.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    heads = stored(
        heads.unionAll(
            root.select(
                F.lit(b"").alias("key"), F.lit(0).alias("depth"), F.lit(b"").alias("path"), "n_convs", "conv_id",
                F.lit(0).cast("long").alias("bytes"),
            )
        )
    )
    inner = placed.where("n_turns > reach")
    dealt = inner.select("conv_id", "keys", "sizes", "reach", F.expr(_key("reach + 1")).alias("container"))
    nodes = stored(
        dealt.repartition("container")
        .sortWithinPartitions("keys", "conv_id")
        .select("conv_id", "keys", "sizes", "reach")
        .mapInArrow(_swept, NODES)
    )
    within, tops = nodes.where("path is null").drop("path"), nodes.where("path is not null")

    def last_key(path: str) -> str:
        return f"case when length({path}) = 0 then X'' else substring({path}, length({path}) - {KEY - 1}, {KEY}) end"

    parents = heads.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    n_heads = heads.count()
    if n_heads <= BROADCAST_ROWS:
        parents = F.broadcast(parents)
    hung = (
        tops.drop("parent_conv_id").withColumn("parent", F.expr(last_key("path"))).join(parents, "parent")
    )

    # What heads are made of: containers below them, heads below them, and their own turns.
    above = f"case when depth = 0 then null else {last_key(f'substring(path, 1, length(path) - {KEY})')} end"
    below = tops.select(F.expr(last_key("path")).alias("key")).unionAll(
        heads.where("depth > 0").select(F.expr(above).alias("key"))
    )
    children = below.groupBy("key").agg(F.count(F.lit(1)).alias("n_children"))
    counted = stored(heads.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    brought = tops.select("path", "n_leaves", "saved_tokens").unionAll(
        counted.select(
            "path",
            (F.col("n_children") == 0).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
        )
    )
    every = F.explode(F.expr(f"sequence(0, cast(length(path) / {KEY} as int))")).alias("d")
    sums = (
        brought.groupBy("path")
        .agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        .select("n_leaves", "saved_tokens", "path", every)
        .withColumn("key", F.expr(f"case when d = 0 then X'' else substring(path, {KEY} * d - {KEY - 1}, {KEY}) end"))
        .groupBy("key")
        .agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    )
    ends = ends_digests(
        placed.where("n_turns = reach").select(
            F.expr(f"case when reach = 0 then X'' else {_key('reach')} end").alias("key"), "conv_id"
        )
    )
    least = heads.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    topmost = (
        counted.withColumn("parent", F.expr(above))
        .join(least, "parent", "left")
        .join(sums, "key")
        .join(ends, "key", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
        .withColumn("depth", F.col("depth").cast("long"))
    )
    names = within.columns
    return within.unionAll(hung.select(names)).unionAll(topmost.select(names))


def _crc32(text: str) -> str:
    """CRC-32 of a SQL string, bit by bit."""
    shift = "lambda x, k: xor(x >> 1, 3988292384 * (x & 1))"
    byte = f"list_reduce(list_concat([xor(x, c)], repeat([0::BIGINT], 8)), {shift})"
    codes = f"list_transform(string_split({text}, ''), lambda s: ord(s)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda x, c: {byte}), 4294967295)"


@query(
    "op12_conversation_trie",
    f"""
    WITH turns AS (
        SELECT conv_id, turn, octet_length(encode(coalesce(text, '')))::BIGINT AS b,
               md5(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS t
        FROM conversations WHERE conv_id IS NOT NULL),
    own AS (
        SELECT conv_id, list({{'t': t, 'b': b}} ORDER BY turn NULLS FIRST, t) AS turns,
               ({_crc32("conv_id::VARCHAR")} % {HEADS})::BIGINT AS h
        FROM turns GROUP BY conv_id),
    whole AS (
        SELECT o.conv_id, list_concat(coalesce(f.turns[1:o.h], []), o.turns[o.h + 1:]) AS turns
        FROM own o LEFT JOIN own f ON f.conv_id = o.conv_id - o.conv_id % {FAMILY}),
    prefixes AS (
        SELECT conv_id, d, turns[1:d] AS p, len(turns) AS n, CASE WHEN d = 0 THEN 0 ELSE turns[d].b END AS b
        FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM whole)),
    nodes AS (
        SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(b) AS saved,
               sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
        FROM prefixes GROUP BY p, d),
    children AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
    below AS (
        SELECT p[1:e] AS p, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves
        FROM (SELECT n.p, saved, (c.n IS NULL)::BIGINT AS leaf, unnest(range(d + 1)) AS e
              FROM nodes n LEFT JOIN children c USING (p)) GROUP BY 1)
    SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
           b.n_leaves, b.saved_tokens, n.ends_sha256
    FROM nodes n JOIN below b ON b.p = n.p LEFT JOIN children c ON c.p = n.p
         LEFT JOIN nodes u ON n.d > 0 AND u.d = n.d - 1 AND u.p = n.p[1:n.d - 1]
    """,
)
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations."""
    return trie_nodes(rebuilt(turns_of(table(spark, sf_dir, "conversations"))))
