"""Chat formatting as a prefix tree.

Conversations that begin with the same turns share the nodes of those turns. A node is a turn after
a given beginning; its digest is that of its parent, role and text. Every node's tokens are emitted
once, in depth-first order, the child that most conversations go on with first. Children that
follow their parent so make paths, which lie end to end in the stream; a node that isn't its
parent's first child begins a path of its own. As each such step at least halves the number of
conversations, a node has at most log2(conversations) + 1 paths above it, whatever its depth: its place
in the order is a key of that many parts, and the tokens that its own attend to are that many intervals.

The order is a range-partitioned sort and the offsets are sums over its parts, so a first turn that
a third of all conversations share is no group in one task. With each node go its place in the
stream, the position of its first token in its conversations, and the stream intervals of its
ancestors and itself, which are all that its tokens attend to.

A turn reads ``### role: text</turn>`` and a line feed. In role and text ``\\`` stands before each
``\\``, ``###`` and ``</turn>``, in a role also before ``:``, so that no text can end or begin a
turn, and taking the escapes away gives back the input. Header, text and end are tokenized apart,
so that the loss mask, the texts of assistants, falls on whole tokens.

Defined results: a null text or role is empty; rows of one conversation are ordered by turn (null
first), then role, then text, and repeated rows are turns of their own; conversations with equal
turns share their leaf; a null conv_id is a conversation like others; no conversations, no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwork.llm.byte_bpe import vocabulary, vocabulary_path
from siftwork.llm.common import table, written

OPEN, CLOSE, ESCAPE = "### ", "</turn>", "\\"

_SPECIAL = re.compile(r"\\|###|</turn>")
_SPECIAL_ROLE = re.compile(r"\\|###|</turn>|:")
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.S)


def escape(text: str, role: bool = False) -> str:
    return (_SPECIAL_ROLE if role else _SPECIAL).sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node and parent of each turn; rows come sorted by conversation and turn, none is held back."""
    conv, started, node, depth = None, False, b"", 0
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("conv_id", "depth", "node", "parent", "role", "text")}
        for c, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if not started or c != conv:
                conv, started, node, depth = c, True, b"", 0
            parent = node
            r, t = role.encode(), text.encode()
            node = hashlib.blake2b(parent + len(r).to_bytes(8, "big") + r + t, digest_size=16).digest()
            for k, v in zip(out, (c, depth, node, parent, role, text), strict=True):
                out[k].append(v)
            depth += 1
        yield pa.RecordBatch.from_arrays([pa.array(out["conv_id"], pa.int64()), pa.array(out["depth"], pa.int32()), *(pa.array(out[k], pa.binary()) for k in ("node", "parent")), pa.array(out["role"], pa.string()), pa.array(out["text"], pa.string())], names=list(out))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key and path of each turn's node, and for a path's first node the nodes at which the paths above it are left.

    A path's nodes are sorted before the paths that leave it, and of those the one that leaves it deepest comes first.
    """
    conv, started, prefix, top, node, above = None, False, b"", b"", b"", []
    for batch in batches:
        keys, tops, lefts = [], [], []
        for c, depth, this, first in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "depth", "node", "is_first")), strict=True):
            if not started or c != conv:
                conv, started, prefix, above = c, True, b"", []
            if depth == 0 or not first:
                if depth:
                    above = [*above, node]
                    prefix += b"\1" + (2**32 - depth).to_bytes(4, "big")
                prefix, top = prefix + this, this
            keys.append(prefix + b"\0" + depth.to_bytes(4, "big"))
            tops.append(top)
            lefts.append(above if this == top else [])
            node = this
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(keys, pa.binary()), pa.array(tops, pa.binary()), pa.array(lefts, pa.list_(pa.binary()))], names=["node", "key", "top", "above"])


def _tokenize(path_: str, learned: str):
    """Tokens and loss spans of each node, and its offset within its part of the order."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import regex

        vocab, split, ids_of, at = vocabulary(path_), regex.compile(public_tokenizers.PATTERN), {}, 0

        def ids(text: str) -> list[int]:
            out: list[int] = []
            for piece in split.findall(text):
                if piece not in ids_of:
                    if len(ids_of) > 200_000:
                        ids_of.clear()
                    ids_of[piece] = vocab.ids(piece.encode())
                out += ids_of[piece]
            return out

        for batch in batches:
            tokens, begin, end, start = [], [], [], []
            for role, text in zip(*(batch.column(c).to_pylist() for c in ("role", "text")), strict=True):
                head, body, tail = ids(f"{OPEN}{escape(role, True)}: "), ids(escape(text)), ids(f"{CLOSE}\n")
                tokens.append(head + body + tail)
                begin.append(len(head))
                end.append(len(head) + len(body) if role == learned else len(head))
                start.append(at)
                at += len(tokens[-1])
            keep = [c for c in batch.schema.names if c not in ("role", "text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(tokens, pa.list_(pa.int32())), pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(start, pa.int64())], names=[*keep, "tokens", "loss_begin", "loss_end", "start"])

    return scan


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, node, parent, role, text of each turn."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", empty("role"), empty("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return written(ordered.mapInArrow(_chain, "conv_id long, depth int, node binary, parent binary, role string, text string"))


def prefix_tree(each_turn: DataFrame, vocabulary_file: str, learned: str = "assistant") -> DataFrame:
    """The stream: node, parent, depth, start, n_tokens, tokens, loss_begin, loss_end, position, intervals.

    ``start`` is the place of the node's first token in the stream, ``position`` its place in every
    conversation through it; loss_begin and loss_end are tokens of the node; ``intervals`` are
    [begin, end) of the paths that lead to it, from the root on, the last one up to and with itself.
    """
    spark = each_turn.sparkSession
    nodes = written(each_turn.groupBy("node").agg(*(F.first(c).alias(c) for c in ("parent", "depth", "role", "text")), F.count("*").alias("n")))
    first = nodes.groupBy("parent").agg(F.max(F.struct("n", "node"))["node"].alias("node")).select("node", F.lit(True).alias("is_first"))
    steps = each_turn.select("conv_id", "depth", "node").join(written(first), "node", "left").select("conv_id", "depth", "node", F.coalesce("is_first", F.lit(False)).alias("is_first"))
    walked = steps.repartition("conv_id").sortWithinPartitions("conv_id", "depth").mapInArrow(_keys, "node binary, key binary, top binary, above array<binary>")
    placed = nodes.join(walked.groupBy("node").agg(*(F.first(c).alias(c) for c in ("key", "top", "above"))), "node")
    # as many parts as a shuffle has, dealt by key: what follows a hot beginning spreads over parts
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = written(placed).repartitionByRange(parts, "key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id())
    kind = "node binary, parent binary, depth int, top binary, above array<binary>, part int, tokens array<int>, loss_begin int, loss_end int, start long"
    emitted = written(ordered.select("node", "parent", "depth", "top", "above", "part", "role", "text").mapInArrow(_tokenize(vocabulary_file, learned), kind))
    sizes = emitted.groupBy("part").agg(F.sum(F.size("tokens")).alias("n"))  # one row for each part
    running = written(sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base")))
    stream = emitted.join(F.broadcast(running), "part").withColumn("n_tokens", F.size("tokens")).withColumn("begin", F.col("start") + F.col("base"))
    tops = stream.where("node = top").select("top", F.col("begin").alias("path_begin"))
    spans = written(stream.select("node", "top", (F.col("begin") + F.col("n_tokens")).alias("end")).join(tops, "top").select("node", F.col("path_begin").alias("begin"), "end"))
    left_at = emitted.where("node = top").select("top", F.posexplode("above").alias("i", "node"))
    before = left_at.join(spans, "node").groupBy("top").agg(F.sort_array(F.collect_list(F.struct("i", "begin", "end"))).alias("s"))
    chains = before.select("top", F.transform("s", lambda x: F.struct(x["begin"].alias("begin"), x["end"].alias("end"))).alias("chain"))
    paths = tops.join(chains, "top", "left")
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    own = F.array(F.struct(F.col("path_begin").alias("begin"), (F.col("begin") + F.col("n_tokens")).alias("end")))
    done = stream.join(written(paths), "top").withColumn("intervals", F.concat(F.coalesce("chain", none), own))
    length = F.aggregate("intervals", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["begin"])
    return done.select("node", "parent", "depth", F.col("begin").alias("start"), "n_tokens", "tokens", "loss_begin", "loss_end", (length - F.col("n_tokens")).alias("position"), "intervals")


def _read(path_: str):
    """One row for each conversation, from the tokens of its nodes in order."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        vocab = vocabulary(path_)
        text_of = lambda ids: vocab.bytes_of(np.array(ids, np.int64))[0].tobytes().decode("utf-8")
        done: list[tuple] = []
        state: list | None = None

        def close() -> None:
            if state is not None:
                conv, n, turns_, loss, chars, formatted = state
                done.append((conv, n, turns_.hexdigest(), chars, loss.hexdigest(), formatted))

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = list(zip(*done, strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for conv, ids, a, b in zip(batch.column("conv_id").to_pylist(), batch.column("tokens").to_pylist(), batch.column("loss_begin").to_pylist(), batch.column("loss_end").to_pylist(), strict=True):
                if state is None or state[0] != conv:
                    close()
                    state = [conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                formatted = text_of(ids)
                ((role, text),) = parse(formatted)
                learned = unescape(text_of(ids[a:b]))
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3].update(learned.encode())
                state[4] += len(learned)
                state[5] += len(formatted)
            if done:
                yield flush()
                done.clear()
        close()
        if done:
            yield flush()

    return scan


def read_back(each_turn: DataFrame, tree: DataFrame, vocabulary_file: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the stream's tokens."""
    rows = each_turn.select("conv_id", "depth", "node").join(tree.select("node", "tokens", "loss_begin", "loss_end"), "node")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "depth").select("conv_id", "tokens", "loss_begin", "loss_end")
    return ordered.mapInArrow(_read(vocabulary_file), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op6_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    each_turn, path = turns(rows), vocabulary_path()
    tree = written(prefix_tree(each_turn, path))
    return read_back(each_turn, tree, path)
