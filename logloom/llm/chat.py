"""Conversations as a prefix tree: shared turns are emitted once, depth first."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import join_unique, parts_for, stored
from logloom.llm.packing import TOKENIZERS, VOCABULARY, Encoder, read_bytes

#: A turn is the head with its role, the text, and the foot. In roles and texts a backslash
#: stands before each sign that could begin one of them, and before each backslash.
HEAD, AFTER_ROLE, FOOT = "### ", ": ", " </turn>\n"
LEARNED = "assistant"
_TEXT_SIGNS = re.compile(r"[\\#<]")
_ROLE_SIGNS = re.compile(r"[\\#<:]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*) </turn>\n", re.DOTALL)
#: Prefixes of conversations are told apart by a polynomial over 127-bit numbers.
_PRIME, _BASE = 2**127 - 1, 0x5DEECE66D1234567F1B3A9C8D7E6F501
_ROWS = 20_000
_NULL = "\x00"


def escaped(text: str) -> str:
    return _TEXT_SIGNS.sub(r"\\\g<0>", text)


def plain(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def head(role: str) -> str:
    return HEAD + _ROLE_SIGNS.sub(r"\\\g<0>", role) + AFTER_ROLE


def parsed(turn: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    found = _TURN.fullmatch(turn)
    if not found:
        raise ValueError("not a turn of this template")
    return plain(found[1]), plain(found[2])


@dataclass(frozen=True)
class ChatTree:
    """``nodes``: a row per distinct turn after the same turns, in depth-first order of ``start``.

    node, parent, depth; owner: the conversation that emits it; start: its place in the
    stream of all tokens; ids; loss_from, loss_to: tokens under the loss mask; position:
    position id of its first token; ancestors: intervals of the stream that it may
    attend to beside itself; conversations: how many share it.

    ``conversations``: conv_key, conv_id, and ``path``: parts of the branches
    (owner, first and last depth, start and end in the stream) that make it up.
    """

    nodes: DataFrame
    conversations: DataFrame


def _key(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(_NULL))


def _tokenized(spark, ordered: DataFrame, vocabulary: str) -> DataFrame:
    """Ids of each turn and running values of its conversation within the partition."""
    held = spark.sparkContext.broadcast(read_bytes(vocabulary))
    schema = (
        "part int, conv string, nth bigint, chain string, before bigint, ids array<int>, "
        "body_from int, body_to int, learned boolean"
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), Encoder(held.value)
        last, nth, chain, before = None, 0, 0, 0
        as_ids = lambda text: np.frombuffer(encoder.encode(text), np.uint16) if text else np.zeros(0, np.uint16)
        for batch in batches:
            rows: list[tuple] = []
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if conv != last:
                    last, nth, chain, before = conv, 0, 0, 0
                pieces = [as_ids(x) for x in (head(role), escaped(text), FOOT)]
                own = xxhash.xxh3_128_intdigest(f"{len(role)}:{role}{text}".encode()) % _PRIME
                chain = (chain * _BASE + own + 1) % _PRIME
                a, b = len(pieces[0]), len(pieces[0]) + len(pieces[1])
                ids = np.concatenate(pieces).astype(np.int32)
                rows.append((part, conv, nth, f"{chain:032x}", before, ids, a, b, role == LEARNED))
                nth, before = nth + 1, before + len(ids)
            if rows:
                columns = list(zip(*rows))
                kinds = [pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(),
                         pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    ["part", "conv", "nth", "chain", "before", "ids", "body_from", "body_to", "learned"],
                )

    return ordered.mapInArrow(task, schema)


def _carried(turns: DataFrame) -> dict[tuple[int, str], tuple[int, int, int]]:
    """What comes before a partition in conversations that go on from earlier ones.

    Partitions are ranges, so there are fewer such entries than partitions.
    """
    last = turns.groupBy("conv", "part").agg(
        F.max_by(F.struct("nth", "chain", (F.col("before") + F.size("ids")).alias("size")), "nth").alias("x")
    )
    several = last.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("conv")
    out: dict[tuple[int, str], tuple[int, int, int]] = {}
    state: dict[str, tuple[int, int, int]] = {}
    for row in last.join(several, "conv", "left_semi").orderBy("conv", "part").collect():
        nth, chain, size = state.get(row["conv"], (0, 0, 0))
        out[row["part"], row["conv"]] = (nth, chain, size)
        n = row["x"]["nth"] + 1
        chain = (chain * pow(_BASE, n, _PRIME) + int(row["x"]["chain"], 16)) % _PRIME
        state[row["conv"]] = (nth + n, chain, size + row["x"]["size"])
    return out


def _paths(turns: DataFrame) -> DataFrame:
    """Node, parent, depth and position of every turn."""
    carried = turns.sparkSession.sparkContext.broadcast(_carried(turns))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = carried.value
        last, parent = None, ""
        for batch in batches:
            nodes, parents, depths, positions = [], [], [], []
            for part, conv, nth, chain, before in zip(*(batch.column(k).to_pylist() for k in range(5))):
                at, first, size = known.get((part, conv), (0, 0, 0))
                if (part, conv) != last:
                    last, parent = (part, conv), f"{first:032x}" if at else ""
                node = f"{(first * pow(_BASE, nth + 1, _PRIME) + int(chain, 16)) % _PRIME:032x}" if at else chain
                nodes.append(node)
                parents.append(parent)
                depths.append(at + nth)
                positions.append(size + before)
                parent = node
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(nodes, pa.string()), pa.array(parents, pa.string()),
                 pa.array(depths, pa.int64()), pa.array(positions, pa.int64()), *batch.columns[5:]],
                ["conv", "node", "parent", "depth", "position", *batch.schema.names[5:]],
            )

    return turns.mapInArrow(
        task,
        "conv string, node string, parent string, depth bigint, position bigint, ids array<int>, "
        "body_from int, body_to int, learned boolean",
    )


def chat_tree(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}",
) -> ChatTree:
    """Prefix tree of the conversations whose turns are the rows of ``turns``.

    Turns are formatted by the template, tokenized in three pieces (head, text, foot),
    and those after the same turns become one node. The loss mask covers the texts of
    assistant turns. Nodes are ordered depth first: conversations are sorted by the
    nodes at which their paths part from others, and each emits the nodes that none
    before it had. ``ancestors`` of a node are the intervals of the stream that its
    path takes.

    Turns go by ``turn_col``, then role, then text; null turns come first, null roles
    and texts count as empty, and rows with a null conversation are one conversation.
    Repeated rows are turns of their own. Empty tables give empty trees. Other columns
    are not read.

    Nothing is collected per conversation or tree: rows are dealt by ranges, running
    values cross partitions through one entry per partition, and turns or
    conversations with many rows are dealt over several tasks in joins.
    """
    spark = turns.sparkSession
    rows = turns.select(
        _key(F.col(conv_col)).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(role_col, F.lit("")).alias("role"),
        F.coalesce(text_col, F.lit("")).alias("text"),
    )
    parts = parts_for(rows.count(), _ROWS)
    order = ["conv", "turn", "role", "text"]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    tokens = stored(_tokenized(spark, ordered.select("conv", "role", "text"), vocabulary), "turns")
    path = stored(_paths(tokens), "paths")

    nodes = path.groupBy("node").agg(
        F.count(F.lit(1)).alias("conversations"),
        *[F.first(c).alias(c) for c in ("parent", "depth", "position", "ids", "body_from", "body_to", "learned")],
    )
    nodes = stored(nodes.withColumn("size", F.size("ids")), "nodes")
    shared = nodes.select("node", F.col("conversations").alias("n"))

    # A node at which fewer conversations go on than at its parent tells paths apart.
    above = shared.select(F.col("node").alias("parent"), F.col("n").alias("above"))
    forks = join_unique(nodes.select("node", "parent", "conversations"), above, ["parent"], ["node"])
    forks = forks.where("above IS NULL OR above <> conversations").select("node")
    forked = join_unique(path.select("conv", "depth", "node"), forks, ["node"], ["conv"], "inner", shared)
    keys = forked.groupBy("conv").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", "node"))), lambda x: x["node"]), "").alias("key")
    )
    keys = stored(keys, "keys")
    sizes = path.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    owned = join_unique(path.select("conv", "node"), keys, ["conv"], ["node"], "inner", sizes)
    owners = owned.groupBy("node").agg(F.min(F.struct("key", "conv")).alias("first"))
    emitted = nodes.join(owners, "node").select("*", "first.key", F.col("first.conv").alias("owner")).drop("first")

    placed = stored(_placed(emitted), "placed")
    starts = _starts(placed).withColumn("end", F.col("start") + F.col("size"))
    starts = stored(starts, "starts")

    spots = starts.select("node", "owner", "start", "end")
    steps = join_unique(path.select("conv", "depth", "node"), spots, ["node"], ["conv"], "inner", shared)
    branches = steps.groupBy("conv", "owner").agg(
        F.min("depth").alias("first"), F.max("depth").alias("last"), F.min("start").alias("start"), F.max("end").alias("end")
    )
    ways = branches.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("first", "last", "owner", "start", "end"))).alias("path")
    )
    ways = stored(ways, "ways")

    inherited = ways.select(
        F.col("conv").alias("owner"),
        F.expr("transform(filter(path, p -> p.owner <> conv), p -> struct(p.start AS start, p.end AS end))").alias("inherited"),
        F.expr("get(filter(path, p -> p.owner = conv), 0).start").alias("own"),
    )
    owning = starts.groupBy("owner").agg(F.count(F.lit(1)).alias("n"))
    whole = join_unique(starts, inherited, ["owner"], ["node"], "inner", owning)
    own = F.when(F.col("start") > F.col("own"), F.array(F.struct(F.col("own").alias("start"), F.col("start").alias("end"))))
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    listed = F.concat("inherited", F.coalesce(own, none))
    # Intervals that touch are one.
    merged = F.aggregate(
        listed,
        none,
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] == x["start"]),
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), x["end"].alias("end"))),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )
    final = whole.select(
        "node", F.nullif("parent", F.lit("")).alias("parent"), "depth", "owner", "start", "ids",
        F.when(F.col("learned"), F.col("body_from")).otherwise(0).alias("loss_from"),
        F.when(F.col("learned"), F.col("body_to")).otherwise(0).alias("loss_to"),
        "position", merged.alias("ancestors"), "conversations",
    )
    kind = turns.schema[conv_col].dataType
    identity = F.when(F.col("conv") == _NULL, F.lit(None)).otherwise(F.col("conv")).cast(kind)
    return ChatTree(final, ways.select(F.col("conv").alias("conv_key"), identity.alias("conv_id"), "path"))


def _placed(emitted: DataFrame) -> DataFrame:
    """Nodes in order, with the tokens before each in its partition."""
    order = ["key", "owner", "depth"]
    parts = parts_for(emitted.count(), _ROWS)
    ordered = emitted.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    chosen = ordered.select(
        F.spark_partition_id().alias("part"), F.lit(0).cast("bigint").alias("before"), F.col("size").cast("bigint").alias("size"),
        "node", "parent", "depth", "owner", "position", "ids", "body_from", "body_to", "learned", "conversations",
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            size = batch.column(2).to_numpy(zero_copy_only=False)
            total = np.cumsum(size)
            before = pa.array(done + total - size, pa.int64())
            done += int(total[-1]) if len(total) else 0
            yield pa.RecordBatch.from_arrays([batch.column(0), before, *batch.columns[2:]], schema=batch.schema)

    return chosen.mapInArrow(task, chosen.schema)


def _starts(placed: DataFrame) -> DataFrame:
    """Places in the whole stream, from the totals of the partitions."""
    spark = placed.sparkSession
    totals = placed.groupBy("part").agg(F.sum("size").alias("n")).orderBy("part").collect()
    rows, done = [], 0
    for row in totals:
        rows.append((row["part"], done))
        done += row["n"]
    offsets = F.broadcast(spark.createDataFrame(rows, "part int, offset bigint"))
    return placed.join(offsets, "part").withColumn("start", F.col("offset") + F.col("before")).drop("part", "before", "offset")


def read_back(tree: ChatTree, vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """Turns of all conversations from the emitted tokens.

    ``conv_key, conv_id, depth, role, text, learned_text, formatted_chars``;
    ``learned_text`` is what the loss mask covers (null without a mask).
    """
    spark = tree.nodes.sparkSession
    held = spark.sparkContext.broadcast(read_bytes(vocabulary))
    asked = tree.conversations.select("conv_key", "conv_id", F.explode("path").alias("p"))
    asked = asked.select(
        "conv_key", "conv_id", F.col("p.owner").alias("owner"), F.explode(F.sequence("p.first", "p.last")).alias("depth")
    )
    emitted = tree.nodes.select("owner", "depth", "ids", "loss_from", "loss_to")
    turns = join_unique(asked, emitted, ["owner", "depth"], ["conv_key"], "inner")
    turns = turns.select("conv_key", "conv_id", "depth", "ids", "loss_from", "loss_to")
    schema = turns.drop("ids", "loss_from", "loss_to").withColumns(
        {"role": F.lit(""), "text": F.lit(""), "learned_text": F.nullif(F.lit(""), F.lit("")), "formatted_chars": F.lit(0).cast("bigint")}
    ).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(held.value)
        for batch in batches:
            out = []
            for ids, a, b in zip(*(batch.column(k).to_pylist() for k in range(3, 6))):
                ids = np.array(ids, np.int64)
                turn = encoder.decode(ids)
                role, text = parsed(turn)
                learned = plain(encoder.decode(ids[a:b])) if role == LEARNED else None
                out.append((role, text, learned, len(turn)))
            columns = list(zip(*out)) or [()] * 4
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array(c, k) for c, k in zip(columns, kinds))],
                [*batch.schema.names[:3], "role", "text", "learned_text", "formatted_chars"],
            )

    return turns.mapInArrow(task, schema)


def digests(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``read_back``; turns pass by in order and are not gathered."""
    ordered = turns.repartition(F.col("conv_key")).sortWithinPartitions("conv_key", "depth")
    kind = turns.schema["conv_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        state, done, ident = None, [], None

        def closed() -> tuple:
            return (ident, state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])

        def out(ids_type: pa.DataType) -> pa.RecordBatch:
            kinds = [ids_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*done)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        ids_type = None
        for batch in batches:
            ids_type = batch.column(1).type
            for key, conv, _, role, text, learned, size in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or state[0] != key:
                    if state is not None:
                        done.append(closed())
                    state, ident = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0], conv
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if learned is not None:
                    state[3] += len(learned)
                    state[4].update(learned.encode())
                state[5] += size
            if done:
                yield out(ids_type)
                done.clear()
        if state is not None:
            done.append(closed())
            yield out(ids_type)

    return ordered.mapInArrow(
        task,
        f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
        "loss_sha256 string, formatted_chars bigint",
    )
