"""Chat formatting as a prefix tree.

Every turn is one segment, `<s>role\\n` text `</s>`; control strings inside roles and texts get a backslash after their
first character, so they never stand in a segment by themselves and come back when it is read. Conversations that begin
with the same turns share their nodes: a node is a whole prefix, named by two 64-bit hashes that are exclusive ors over
its turns, so one window gives them in one ordered pass. Nodes are emitted once, depth-first: conversations are ranked
by their paths, of which only the shared part and one node beyond is needed, a node belongs to the first conversation
through it, and its offset is a running sum over (rank, depth), added up by range partitions. A node's tokens attend to
themselves causally and to its ancestors' tokens, as intervals of the emitted stream; neighbours in it are merged.

A first turn that a third of all conversations share is one row after map-side aggregation; its conversations stay
spread by rank and meet its node by broadcast. Turns of one conversation are read in order as a stream, never gathered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolode.llm._session import checkpoint, hot_join

OPEN, CLOSE, HEAD = "<s>", "</s>", "\n"
# Control strings of the template family; a backslash goes behind the first character of each.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_STARTS = r"(\\|<(?=/?s>|</?SYS>>)|\[(?=/?INST\]))"
_MARK = re.compile(r"\\(\\?)")
LEARNED = "assistant"
_KEY = ("k1", "k2")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _STARTS, r"$1\\")


def unescape(text: str) -> str:
    return _MARK.sub(lambda m: m[1], text)


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _read_role(role: str) -> str:
    return re.sub(r"\\(\\|n)?", lambda m: {"\\": "\\", "n": "\n", None: ""}[m[1]], role)


def read_segment(segment: str) -> tuple[str, str, int, int]:
    """Role, text, and where the escaped text begins and ends, of one emitted segment."""
    head = segment.index(HEAD)
    if not segment.startswith(OPEN) or not segment.endswith(CLOSE) or segment.count(OPEN) != 1 or segment.count(CLOSE) != 1:
        raise ValueError(f"not one turn: {segment[:80]!r}")
    begin, end = head + len(HEAD), len(segment) - len(CLOSE)
    return _read_role(segment[len(OPEN) : head]), unescape(segment[begin:end]), begin, end


def _running(df: DataFrame, order: list[str], value: Column, out: str) -> DataFrame:
    """Adds the sum of value over all rows before each row in order: sums of range partitions, then within each."""
    r = checkpoint(df.withColumn("_value", value).repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    total, before = 0, []
    for row in r.groupBy("_pid").agg(F.sum("_value").alias("s")).orderBy("_pid").collect():  # one row a partition
        before.append((row["_pid"], total))
        total += row["s"]
    offsets = df.sparkSession.createDataFrame(before or [(-1, 0)], "_pid int, _before long")
    w = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = r.withColumn(out, F.coalesce(F.sum("_value").over(w), F.lit(0)))
    return summed.join(F.broadcast(offsets), "_pid").withColumn(out, F.col(out) + F.col("_before")).drop("_pid", "_before", "_value")


def _tokens(df: DataFrame, tokenizer: str | None) -> DataFrame:
    """Adds n_tokens of segment: its code points, or by the vocabulary file of a tokenizer its token ids."""
    if tokenizer is None:
        return df.withColumn("n_tokens", F.length("segment").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        for b in batches:
            ids = [x.ids for x in t.encode_batch(b.column("segment").to_pylist(), add_special_tokens=False)]
            yield pa.record_batch([*b.columns, pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64())], [*b.schema.names, "token_ids", "n_tokens"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]))


def build(conversations: DataFrame, *, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and members of the tree of conversations (conv_id, turn, role, text).

    nodes: k1, k2, parent1, parent2 (null of a first turn), depth, segment, loss_from, loss_to (offsets of the text in
    the segment's code points, null where nothing is learned), n_tokens, position (of its first token in any
    conversation), start (of its first token in the stream), attends (array of {from, to}), n_conversations, and
    token_ids with a tokenizer. members: conv_id, depth, k1, k2.

    A null text or role counts as empty; turns order by turn, null first; turns of equal number by role and text, all
    kept, also if they repeat. Rows with a null conv_id are one conversation. Other columns play no part. An empty
    table gives empty ones.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("depth", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")))
    head = F.concat(F.lit(OPEN), _role(F.col("role")), F.lit(HEAD))
    body = escape(F.col("text"))
    rows = rows.select("conv_id", "depth", F.concat(head, body, F.lit(CLOSE)).alias("segment"),
                       F.when(F.col("role") == LEARNED, F.length(head)).cast("long").alias("loss_from"),
                       F.when(F.col("role") == LEARNED, F.length(head) + F.length(body)).cast("long").alias("loss_to"))
    rows = _tokens(rows, tokenizer)
    ordered = Window.partitionBy("conv_id").orderBy("depth")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    for i, k in enumerate(_KEY):
        rows = rows.withColumn(k, F.bit_xor(F.xxhash64(F.lit(i), "depth", "segment")).over(upto))
        rows = rows.withColumn(f"parent{i + 1}", F.lag(k).over(ordered))
    rows = rows.withColumn("position", F.sum("n_tokens").over(upto) - F.col("n_tokens"))
    rows = checkpoint(rows)
    members = rows.select("conv_id", "depth", *_KEY)
    facts = ["parent1", "parent2", "depth", "segment", "loss_from", "loss_to", "n_tokens", "position", *(["token_ids"] if tokenizer else [])]
    nodes = rows.groupBy(*_KEY).agg(*[F.first(c).alias(c) for c in facts], F.count(F.lit(1)).alias("n_conversations"))
    # Of conversations that are equal throughout one stands for all.
    last = members.groupBy("conv_id").agg(F.max(F.struct("depth", *_KEY)).alias("leaf"))
    one = last.groupBy("leaf").agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id")).alias("of")).select(F.col("of.conv_id").alias("rep"))
    own = checkpoint(members.join(one, F.col("conv_id").eqNullSafe(F.col("rep"))).drop("rep"))
    through = checkpoint(own.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("paths")))
    own = checkpoint(hot_join(own, through, list(_KEY), "paths").withColumn("shared", F.col("paths") > 1))
    paths = (own.withColumn("n", F.sum(F.col("shared").cast("int")).over(Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)))
             .filter(F.col("shared") | (F.col("depth") == F.col("n") + 1)).groupBy("conv_id")
             .agg(F.array_sort(F.collect_list(F.struct("depth", *_KEY))).alias("path")))
    ranked = _running(paths, ["path"], F.lit(1).cast("long"), "rank").select(F.col("conv_id").alias("rep"), "rank")
    own = own.join(ranked, F.col("conv_id").eqNullSafe(F.col("rep"))).drop("rep", "conv_id", "shared", "paths")
    own = checkpoint(own)
    owner = own.groupBy(*_KEY).agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("paths"))
    nodes = _running(nodes.join(owner, list(_KEY)), ["rank", "depth"], F.col("n_tokens"), "start")
    nodes = checkpoint(nodes)
    spans = hot_join(own, nodes.select(*_KEY, "start", "n_tokens", F.col("rank").alias("first"), "paths"), list(_KEY), "paths")
    spans = spans.select("rank", "depth", *_KEY, "start", "n_tokens", (F.col("first") == F.col("rank")).alias("mine"))
    attends = spans.repartition("rank").sortWithinPartitions("rank", "depth").mapInArrow(_attention, "k1 long, k2 long, attends array<struct<from:long,to:long>>")
    return checkpoint(nodes.drop("rank", "paths").join(attends, list(_KEY))), members


def _attention(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each conversation by depth: of its own nodes, the merged intervals of all nodes before."""
    kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    current, spans = None, []
    for b in batches:
        k1, k2, found = [], [], []
        for rank, _, a, c, start, n, mine in zip(*[x.to_pylist() for x in b.columns], strict=True):
            if rank != current:
                current, spans = rank, []
            if mine:
                k1.append(a)
                k2.append(c)
                found.append([{"from": x, "to": y} for x, y in spans])
            if spans and spans[-1][1] == start:
                spans[-1] = (spans[-1][0], start + n)
            else:
                spans.append((start, start + n))
        yield pa.record_batch([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(found, kind)], ["k1", "k2", "attends"])


def read_back(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) as read from the emitted segments."""
    rows = hot_join(members, nodes.select(*_KEY, "segment", "loss_from", "loss_to", "n_conversations"), list(_KEY), "n_conversations").select("conv_id", "depth", "segment", "loss_from", "loss_to")
    kind = rows.schema["conv_id"].dataType
    out = T.StructType([T.StructField("conv_id", kind), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, schema = None, None, None
        for b in batches:
            schema = schema or pa.schema([("conv_id", b.schema.field("conv_id").type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
            done = []
            for conv, _, segment, a, z in zip(*[x.to_pylist() for x in b.columns], strict=True):
                if state is None or conv != current:
                    if state is not None:
                        done.append(_finish(current, state))
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, _, _ = read_segment(segment)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if a is not None:
                    learned = unescape(segment[a:z])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(segment)
            yield pa.RecordBatch.from_pylist(done, schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([_finish(current, state)], schema)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "depth").mapInArrow(read, out)


def _finish(conv, state: list) -> dict:
    return {"conv_id": conv, "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]}
