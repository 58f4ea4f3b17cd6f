"""Prefix trie of conversations by truncation peeling.

A node is a distinct sequence of first turns. The trie is peeled from the deepest depth up: what is alive at a depth are the
nodes one deeper, less their last turn, and the conversations that end here. Both meet by prefix, which
makes the nodes of this depth, and their sums (members, children, leaves, saved tokens) in the same grouping.

1. ``ranked``: turns are hashed where they are read (no text is shuffled), dealt out by range of (conversation,
   turn) and numbered by running counts, so that one endless conversation is many ranges.
2. ``rebuilt``: the first turns of another conversation, then the own ones after them.
3. ``prefixes``: the hash of a prefix is a wrapping sum of 128 bits over (place, turn), kept in blocks of ``BLOCK`` depths.
4. ``endings``: equal whole conversations are one row with their number, smallest id and the digest of their
   ids. Ids are joined in pieces by range before one stream per group digests the pieces in order.
5. ``peel``: one grouping per depth. A row carries one block of prefixes, and meets the next block at its edge.
   Depths that one sequence has to itself are written out at once, so the rounds follow the depth of what is shared.
6. Parents: nodes meet their parents by prefix. Parents with very many children, of which there are few, are broadcast.

Prefixes are compared by 128-bit hashes.

Cases: null role and text are empty. Turns go by turn, null first; equal turns by a hash of role and text, and repeated
rows are turns of their own. Rows with a null id take no part. A conversation without turns after rebuilding ends at the
root. An empty table gives no rows. Very long texts are hashed whole. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskweave.llm.common import mix64, ship, table
from riskweave.llm.resample import crc32_sql
from riskweave.session import materialise

CHUNK = 64  # own turns in one row
BLOCK = 16  # depths whose prefixes one row holds
PIECE = 1 << 14  # bytes of joined ids in one row
MANY_CHILDREN = 1000
MANY_PARENTS = 10_000  # parents that are broadcast at most
_NO_IDS = hashlib.sha256(b"").hexdigest()


def ranked(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, rank, turn): every turn's place in its conversation, and its hash and bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes")
    ).filter("conv_id is not null")
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("key")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "key", "bytes", F.spark_partition_id().cast("long").alias("range"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, 0
        for b in batches:
            ids = b.column(0).to_numpy()
            if not len(ids):
                continue
            begins = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            rank = np.arange(1, len(ids) + 1) - np.repeat(begins, np.diff(np.append(begins, len(ids))))
            if ids[0] == last:
                rank[ids == last] += held
            last, held = ids[-1], int(rank[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rank)], [*b.schema.names, "rank"])

    written = materialise(dealt.mapInArrow(number, "conv_id long, key binary, bytes long, range long, rank long"), "turns")
    # One row per range: where a conversation goes on from the range before, its places go on too.
    ends = written.groupBy("range").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "rank")).alias("last")).collect()
    starts, open_id, held = [], None, 0
    for r in sorted(ends, key=lambda r: r["range"]):
        more = held if r["first"] == open_id else 0
        starts.append((r["range"], r["first"], more))
        open_id, held = r["last"].conv_id, r["last"]["rank"] + (more if r["last"].conv_id == r["first"] else 0)
    dim = written.sparkSession.createDataFrame(starts, "range long, first long, more long")
    place = F.col("rank") + F.when(F.col("conv_id") == F.col("first"), F.col("more")).otherwise(0)
    return written.join(F.broadcast(dim), "range").select("conv_id", place.alias("rank"), F.struct("key", "bytes").alias("turn"))


def rebuilt(turns: DataFrame, base_of: Callable[[Column], Column], taken: Callable[[Column], Column], most: int) -> DataFrame:
    """(conv_id, chunk, turns): every conversation as the first ``taken`` turns (``most`` at most) of its base, then its own turns after as many."""
    chunk = ((F.col("rank") - 1) / CHUNK).cast("long").alias("chunk")
    listed = F.array_sort(F.collect_list(F.struct("rank", "turn"))).alias("own")  # CHUNK turns at most
    chunks = materialise(turns.groupBy("conv_id", chunk).agg(listed), "chunks")
    first = chunks.filter("chunk = 0")
    bases = first.select(F.col("conv_id").alias("base"), F.slice("own", 1, most).alias("heads"))
    heads = F.slice(F.coalesce("heads", F.array().cast(bases.schema["heads"].dataType)), F.lit(1), F.col("h"))
    joined = first.withColumn("base", base_of(F.col("conv_id"))).withColumn("h", taken(F.col("conv_id")).cast("int")).join(bases, "base", "left")
    joined = joined.withColumn("heads", F.transform(heads, lambda x: x["turn"]))
    rest = F.transform(F.filter("own", lambda x: x["rank"] > F.col("h")), lambda x: x["turn"])
    opening = joined.select("conv_id", F.lit(0).cast("long").alias("chunk"), F.concat("heads", rest).alias("turns"))
    later = chunks.filter("chunk > 0").select("conv_id", "chunk", F.transform("own", lambda x: x["turn"]).alias("turns"))
    return opening.unionByName(later)


def prefixes(chunks: DataFrame, block: int) -> DataFrame:
    """(conv_id, block, p1, p2, upto, depth): prefix hashes and bytes of ``block`` depths each.

    The arrays begin with the depth before the block's first. ``depth`` is that of the whole
    conversation, in the row of its last block only. Conversations without turns are left out.
    """
    schema = "conv_id long, block long, p1 array<long>, p2 array<long>, upto array<long>, depth long"

    def emit(conv: np.ndarray, place: np.ndarray, sums: np.ndarray, before: np.ndarray, closed: bool) -> Iterator[pa.RecordBatch]:
        """Rows of whole blocks; ``before`` are the sums one place earlier."""
        number = (place - 1) // block
        begins = np.flatnonzero(np.append(True, (conv[1:] != conv[:-1]) | (number[1:] != number[:-1])))
        ends = np.append(begins[1:], len(conv))
        # Each row is the sums before its first place, then those of its places.
        at = np.insert(np.arange(len(conv)), begins, -1 - begins)
        values = np.where((at < 0)[:, None], before[np.where(at < 0, -1 - at, 0)], sums[np.maximum(at, 0)])
        offsets = pa.array(np.append(0, np.cumsum(ends - begins + 1)).astype(np.int32))
        last = np.append(conv[ends[:-1]] != conv[begins[:-1]], closed)
        depth = pa.array(place[ends - 1], mask=~last)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values[:, k]).view(np.int64))) for k in range(3)]
        for low in range(0, len(begins), 5000):
            part = slice(low, low + 5000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(conv[begins[part]]), pa.array(number[begins[part]]), *(x[low : low + 5000] for x in lists), depth[low : low + 5000]],
                ["conv_id", "block", "p1", "p2", "upto", "depth"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last block of the last conversation waits: the next batch may go on with it.
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 3), np.uint64), np.empty((0, 3), np.uint64))
        for b in batches:
            sizes = np.asarray(b.column(1).value_lengths())
            conv = np.repeat(b.column(0).to_numpy(), sizes)
            if not len(conv):
                continue
            flat = b.column(1).flatten()
            keys = np.frombuffer(b"".join(flat.field("key").to_pylist()), np.uint64).reshape(-1, 2)
            begins = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
            runs = np.diff(np.append(begins, len(conv)))
            goes_on = len(held[0]) > 0 and held[0][-1] == conv[0]
            place = np.arange(1, len(conv) + 1) - np.repeat(begins, runs)
            if goes_on:
                place[: runs[0]] += held[1][-1]
            spot = mix64(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            added = np.stack([mix64(keys[:, 0] + spot), mix64(keys[:, 1] ^ mix64(spot)), flat.field("bytes").to_numpy().astype(np.uint64)], axis=1)
            total = np.cumsum(added, axis=0, dtype=np.uint64)
            start = total[begins] - added[begins]
            if goes_on:
                start[0] -= held[2][-1]
            sums = total - np.repeat(start, runs, axis=0)
            before = sums - added
            conv, place, sums, before = (np.concatenate(x) for x in zip(held, (conv, place, sums, before)))
            keep = len(conv) - 1 - (place[-1] - 1) % block
            if keep:
                yield from emit(conv[:keep], place[:keep], sums[:keep], before[:keep], conv[keep - 1] != conv[keep])
            held = (conv[keep:], place[keep:], sums[keep:], before[keep:])
        if len(held[0]):
            yield from emit(*held, True)

    dealt = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").select("conv_id", "turns")
    return dealt.mapInArrow(run, schema)


_GROUP = ["depth", "p1", "p2"]


def endings(ended: DataFrame) -> DataFrame:
    """(depth, p1, p2, conv_id, n, ends_sha256) of each distinct whole conversation, from rows (depth, p1, p2, conv_id)."""

    def cuts_of(b: pa.RecordBatch) -> list[int]:
        columns = [b.column(i).to_numpy() for i in range(3)]
        changed = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
        return [0, *(np.flatnonzero(changed) + 1).tolist(), b.num_rows]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            cuts = cuts_of(b) if b.num_rows else [0]
            for low, high in zip(cuts[:-1], cuts[1:]):
                key = [b.column(i)[low].as_py() for i in range(3)]
                ids = b.column(3).slice(low, high - low).to_pylist()
                for at in range(0, len(ids), PIECE // 20):
                    some = ids[at : at + PIECE // 20]
                    rows.append((*key, some[0], len(some), ",".join(map(str, some)).encode()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], [*_GROUP, "conv_id", "n", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, None
        done: list[tuple] = []
        for b in batches:
            for *key, first, n, ids in zip(*(c.to_pylist() for c in b.columns)):
                if key != group:
                    if group is not None:
                        done.append((*group, *state[:2], state[2].hexdigest()))
                    group, state = key, [first, n, hashlib.sha256(ids)]
                else:
                    state[1] += n
                    state[2].update(b"," + ids)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], [*_GROUP, "conv_id", "n", "ends_sha256"])
                done = []
        if group is not None:
            last = (*group, *state[:2], state[2].hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in last], [*_GROUP, "conv_id", "n", "ends_sha256"])

    key = "depth long, p1 long, p2 long, conv_id long, n long"
    order = [*_GROUP, "conv_id"]
    # Ids are joined where they lie, by range, so that a group of many copies reaches its digest in few rows.
    pieces = ended.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, f"{key}, ids binary")
    return pieces.repartition(*_GROUP).sortWithinPartitions(*order).mapInArrow(digest, f"{key}, ends_sha256 string")


_NODE = ["depth", "p1", "p2", "pp1", "pp2", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_CARRIED = ["a1", "a2", "upto"]


def _private(groups: DataFrame, blocks: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of the blocks that one sequence has to itself, and the sequences cut before them.

    The second has (depth, conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): for a cut sequence
    what its private part adds up to, where it joins the shared part.
    """
    mine = blocks.join(groups.select("conv_id", "n", F.col("ends_sha256").alias("sha"), F.col("depth").alias("whole")), "conv_id")
    own = mine.filter("block > 0").withColumns({"s1": F.element_at("a1", 1), "s2": F.element_at("a2", 1)})
    alone = own.groupBy("block", "s1", "s2").agg(F.count(F.lit(1)).alias("c"), F.min("conv_id").alias("conv_id")).filter("c = 1")
    first = alone.groupBy("conv_id").agg(F.min("block").alias("cut"))
    cut = materialise(mine.join(first, "conv_id", "left"), "trie-cut")
    total = cut.filter("depth is not null").select("conv_id", F.element_at("upto", -1).alias("bytes"))
    chains = cut.filter("block >= cut").join(total, "conv_id").select("*", F.posexplode("a1").alias("i", "p1")).filter("i > 0")
    here = F.col("block") * block + F.col("i")
    at = lambda c, shift: F.element_at(c, F.col("i") + shift)
    last = here == F.col("whole")
    nodes = chains.select(
        here.alias("depth"), "p1", at("a2", 1).alias("p2"), at("a1", 0).alias("pp1"), at("a2", 0).alias("pp2"), "conv_id", F.col("n").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("n") - 1) * (F.col("bytes") - at("upto", 0))).alias("saved_tokens"), F.when(last, F.col("sha")).alias("ends_sha256"),
    )
    joining = cut.filter("block = cut").join(total, "conv_id").select(
        (F.col("block") * block).alias("depth"), "conv_id", F.col("n").alias("n_convs"), F.lit(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("n") - 1) * (F.col("bytes") - F.element_at("upto", 1))).alias("saved_tokens"), F.lit(None).cast("string").alias("ends_sha256"),
    )
    return nodes, joining.unionByName(_whole(cut.filter("cut is null and depth is not null").withColumn("ends_sha256", F.col("sha"))))


def _whole(groups: DataFrame) -> DataFrame:
    """Sequences that end, as they enter the peeling."""
    zero = F.lit(0).cast("long")
    return groups.select("depth", "conv_id", F.col("n").alias("n_convs"), zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"), "ends_sha256")


def peel(groups: DataFrame, blocks: DataFrame, block: int) -> list[DataFrame]:
    """Nodes of depth one and more, as written tables of ``_NODE``."""
    deepest = groups.agg(F.max("depth")).first()[0] or 0
    tables = []
    if deepest > block:
        nodes, entering = _private(groups.filter("depth > 0"), blocks, block)
        tables.append(materialise(nodes.select(*_NODE), "trie-private"))
        entering = materialise(entering, "trie-entering")
    else:
        entering = _whole(groups.filter("depth > 0"))
    deepest = entering.agg(F.max("depth")).first()[0] or 0
    alive = None
    for depth in range(deepest, 0, -1):
        number, place = divmod(depth - 1, block)
        edge = depth % block == 0 or depth == deepest
        here = blocks.filter(F.col("block") == number).select("conv_id", *_CARRIED)
        if edge:
            # All that ends within this block takes its prefixes along; so do the nodes that come from the block after it.
            ending = entering.filter((F.col("depth") > number * block) & (F.col("depth") <= (number + 1) * block)).join(here, "conv_id")
            ending = materialise(ending, "trie-ending")
            alive = alive if alive is None else alive.drop(*_CARRIED).join(here, "conv_id")
        now = ending.filter(F.col("depth") == depth).drop("depth")
        now = now if alive is None else now.unionByName(alive)
        here_at = lambda c, i: F.element_at(c, place + i)  # noqa: B023, E731
        grouped = now.groupBy(here_at("a1", 2).alias("p1"), here_at("a2", 2).alias("p2")).agg(
            F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("under"),
            F.sum("saved_tokens").alias("below"), F.max("ends_sha256").alias("ends_sha256"), *[F.any_value(c).alias(c) for c in _CARRIED],
        )
        own = (F.col("n_convs") - 1) * (here_at("upto", 2) - here_at("upto", 1))
        level = materialise(
            grouped.select(
                F.lit(depth).cast("long").alias("depth"), "p1", "p2", here_at("a1", 1).alias("pp1"), here_at("a2", 1).alias("pp2"), "conv_id", "n_convs", "n_children",
                F.greatest("under", F.lit(1)).alias("n_leaves"), (F.col("below") + own).alias("saved_tokens"), "ends_sha256", *_CARRIED,
            ),
            "trie-level",
        )
        tables.append(level.select(*_NODE))
        # Stripped of its last turn, a node is one child, and ends nowhere.
        alive = level.select(
            "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends_sha256"), *_CARRIED
        )
    return tables


def _with_parents(nodes: DataFrame, root_id: int) -> DataFrame:
    """Add ``parent_conv_id`` to nodes of depth one and more."""
    many = max(MANY_CHILDREN, nodes.count() // MANY_PARENTS)
    parents = nodes.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("pp1"), F.col("p2").alias("pp2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    key = ["depth", "pp1", "pp2"]
    # No more than MANY_PARENTS have so many children; all others have a bounded number.
    known = nodes.join(F.broadcast(parents.filter(F.col("n_children") >= many).select(*key, F.col("parent_conv_id").alias("crowded"))), key, "left")
    below_root = known.filter("depth = 1").withColumn("parent_conv_id", F.lit(root_id).cast("long"))
    crowded = known.filter("depth > 1 and crowded is not null").withColumn("parent_conv_id", F.col("crowded"))
    others = known.filter("depth > 1 and crowded is null").join(parents.filter(F.col("n_children") < many).select(*key, "parent_conv_id"), key)
    return below_root.unionByName(crowded).unionByName(others.select(*below_root.columns))


def trie(
    conversations: DataFrame, base_of: Callable[[Column], Column], taken: Callable[[Column], Column], most: int, id_col: str = "conv_id",
    turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK,
) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations, the root (depth 0) included."""
    spark = conversations.sparkSession
    ship(spark)
    whole = materialise(rebuilt(ranked(conversations, id_col, turn_col, role_col, text_col), base_of, taken, most), "rebuilt")
    blocks = materialise(prefixes(whole, block), "prefixes").withColumnsRenamed({"p1": "a1", "p2": "a2"})
    zero = F.lit(0).cast("long")
    # A base gives fewer turns than a chunk holds, so what has no turns in its first chunk has none.
    turnless = whole.filter((F.col("chunk") == 0) & (F.size("turns") == 0)).select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv_id")
    ended = blocks.filter("depth is not null").select("depth", F.element_at("a1", -1).alias("p1"), F.element_at("a2", -1).alias("p2"), "conv_id")
    groups = materialise(endings(ended.unionByName(turnless)), "endings")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    tables = peel(groups, blocks, block)
    at_root = groups.filter("depth = 0").select("conv_id", F.col("n").alias("n_convs"), zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"), "ends_sha256")
    tops = [t.filter("depth = 1").select("conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends_sha256")) for t in tables]
    merged = reduce(DataFrame.unionByName, tops, at_root).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.greatest(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("ends_sha256").alias("ends_sha256"),
    )
    root = materialise(merged.filter("n_convs > 0").withColumns({"depth": zero, "parent_conv_id": F.lit(None).cast("long")}).select(*columns), "trie-root")
    top = root.first()
    out = root if top is None or not tables else root.unionByName(_with_parents(reduce(DataFrame.unionByName, tables), top.conv_id).select(*columns))
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_IDS)))


#: The conversations that op13 rebuilds: groups of FIVE ids, NINE lengths of the borrowed opening.
FIVE = 5
NINE = 9


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = lambda c: F.crc32(c.cast("string").cast("binary")) % NINE
    return trie(table(spark, sf_dir, "conversations"), lambda c: c - c % FIVE, taken, NINE - 1)


def op13_sql() -> str:
    return f"""
    WITH own AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS r
        FROM conversations WHERE conv_id IS NOT NULL),
    ids AS (
        SELECT conv_id, {crc32_sql("CAST(conv_id AS VARCHAR)")} % {NINE} AS h, conv_id - conv_id % {FIVE} AS base
        FROM (SELECT DISTINCT conv_id FROM own)),
    made AS (
        SELECT ids.conv_id, role, text, 0 AS part, r FROM ids JOIN own ON own.conv_id = ids.base AND r <= h
        UNION ALL SELECT ids.conv_id, role, text, 1, r FROM ids JOIN own USING (conv_id) WHERE r > h),
    placed AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY part, r) AS depth FROM made),
    prefix AS (
        SELECT conv_id, depth, text, list({{'role': role, 'text': text}}) OVER (PARTITION BY conv_id ORDER BY depth) AS turns FROM placed
        UNION ALL SELECT conv_id, 0, '', [] FROM ids),
    member AS (
        SELECT conv_id, depth, text, min(conv_id) OVER (PARTITION BY depth, turns) AS node,
            depth = max(depth) OVER (PARTITION BY conv_id) AS ends
        FROM prefix),
    nodes AS (
        SELECT node, depth, count(*) AS n_convs, max(strlen(text)) AS bytes,
            sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
        FROM member GROUP BY node, depth),
    parents AS (
        SELECT n.node, n.depth, m.node AS parent
        FROM nodes n LEFT JOIN member m ON m.conv_id = n.node AND m.depth = n.depth - 1),
    kids AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n FROM parents WHERE depth > 0 GROUP BY ALL),
    under AS (
        SELECT a.node, a.depth, count(*) FILTER (kids.n IS NULL) AS n_leaves, sum((x.n_convs - 1) * x.bytes) AS saved
        FROM nodes x LEFT JOIN kids ON kids.node = x.node AND kids.depth = x.depth
        JOIN member a ON a.conv_id = x.node AND a.depth <= x.depth
        GROUP BY a.node, a.depth)
    SELECT nodes.node AS conv_id, CAST(nodes.depth AS BIGINT) AS depth, parent AS parent_conv_id, n_convs,
        CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
    FROM nodes JOIN under USING (node, depth) JOIN parents USING (node, depth) LEFT JOIN kids USING (node, depth)"""
