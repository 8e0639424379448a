"""The prefix trie of conversations, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns; its key is the exclusive or of 128-bit hashes of (depth, role, text), so the keys of
all prefixes of a conversation are a running sum. A node goes by its least member and its depth.

Totals go from children to parents. The trie is cut into connected pieces: below a node with more than LIGHT members each
child with fewer starts a piece, and so does every BAND-th level. Pieces are dealt to shards. A shard reads its
nodes sorted externally in reverse level order; a node takes what its children left for it from a priority queue, adds its own and
leaves the sum for its parent. The queue spills sorted runs, so memory does not follow the size of a piece. The roots of
pieces that have pieces below them then form a tree of their own, which is processed in the same way; last, the shards of these pieces pass
up what came from below.

A hot conversation is cut into partitions and bands, a hot prefix into the pieces below it, members are counted before the shuffle.
The digest of the members that end at a node is one hash over all their ids: they come in packed runs and are
streamed through one task a node.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doppel.llm.batches import width, written

LIGHT = 256       # members
BAND = 4096       # levels
HELD = 1 << 20    # messages in memory
RUN_IDS = 1 << 16  # ids in a run for a digest
WORD = r"[^\x20\x09-\x0D]+"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1, by turn, null first), a, b (hashes of role and text), words (of the text).

    conversations: conv_id, turn, role, text; other columns are ignored. Null roles and texts are empty, rows without a conv_id
    are left out. Rows of one turn follow by role, then by a hash of the text; repeated rows are turns of their own.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), F.xxhash64(role, text).alias("a"),
        F.xxhash64(text, role, F.lit(1)).alias("b"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "a", "b"]

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for frame in frames:
            if not len(frame):
                continue
            ids = frame["conv_id"].to_numpy()
            first = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
            place = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids)))) + 1
            if ids[0] == last:
                place[:first[1] if len(first) > 1 else len(ids)] += seen
            last, seen = ids[-1], place[-1]
            yield frame.assign(part=part, place=place)

    # A long conversation spans several partitions.
    placed = written(rows.repartitionByRange(width(rows.sparkSession), *order).sortWithinPartitions(*order).select("conv_id", "a", "b", "words")
                     .mapInPandas(number, "conv_id long, a long, b long, words long, part long, place long"), "turns")
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # At most one conversation a partition goes on from the one before it.
    offsets = placed.groupBy("conv_id", "part").agg(F.max("place").alias("n")).select("conv_id", "part", before.alias("before")).where("before > 0")
    return placed.join(F.broadcast(offsets), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "a", "b", "words")


def with_shared_heads(turns: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like others: the first h turns of conversation c - c % every, then their own after the first h.

    turns: as ordered() returns them; h is the crc32 of the decimal c modulo `heads`. Returns turns with `depth` in place of pos, and
    conv_id, n_turns of all conversations, also those left without turns.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    base = F.col("conv_id") - F.col("conv_id") % every
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("own")).select("conv_id", "own", h.alias("h"), base.alias("base"))
    sizes = convs.select(F.col("conv_id").alias("base"), F.least("own", F.lit(heads)).alias("there"))
    convs = convs.join(sizes, "base", "left").select(
        "conv_id", "h", "base", F.least("h", F.coalesce("there", F.lit(0))).alias("taken"), "own")
    head = turns.where((F.col("pos") <= heads) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "base")
    first = convs.join(head, "base").where("pos <= taken").select("conv_id", F.col("pos").alias("depth"), "a", "b", "words")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "a", "b", "words")
    return first.unionByName(own), convs.select("conv_id", (F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("n_turns"))


class Queue:
    """Messages (level, id, leaves, saved) in ascending order of level and id; beyond `most` they are spilled as sorted runs.

    Runs lie in unnamed files of the task's own, as Spark's sorter keeps its own: they go with the task, whose retry makes them anew.
    """

    BLOCK = 1 << 15

    def __init__(self, most: int = HELD):
        self.most, self.parts, self.held, self.runs = most, [], 0, []

    @staticmethod
    def combined(rows: np.ndarray) -> np.ndarray:
        """Rows in order, one for each level and id."""
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        if len(rows) < 2:
            return rows
        new = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        at = np.flatnonzero(new)
        return np.column_stack([rows[at, :2], np.add.reduceat(rows[:, 2:], at, axis=0)])

    @staticmethod
    def upto(rows: np.ndarray, level: int, last: int) -> int:
        low, high = np.searchsorted(rows[:, 0], [level, level + 1])
        return int(low + np.searchsorted(rows[low:high, 1], last, "right"))

    def push(self, level: np.ndarray, ids: np.ndarray, leaves: np.ndarray, saved: np.ndarray) -> None:
        if len(ids):
            self.parts.append(self.combined(np.column_stack([level, ids, leaves, saved])))
            self.held += len(self.parts[-1])
        if len(self.parts) > 16 or self.held > self.most:
            self.parts = [self.combined(np.concatenate(self.parts))]
            self.held = len(self.parts[0])
        if self.held > self.most:
            file = tempfile.TemporaryFile()
            file.write(np.ascontiguousarray(self.parts[0]).tobytes())
            file.seek(0)
            self.runs.append([file, np.zeros((0, 4), np.int64)])
            self.parts, self.held = [], 0

    def pop(self, level: int, last: int) -> np.ndarray:
        """All messages up to this level and id, one for each."""
        out, rest = [], []
        for part in self.parts:
            at = self.upto(part, level, last)
            out.append(part[:at])
            if at < len(part):
                rest.append(part[at:])
        self.parts, self.held = rest, sum(map(len, rest))
        for run in self.runs:
            while True:
                if not len(run[1]):
                    run[1] = np.frombuffer(run[0].read(32 * self.BLOCK), np.int64).reshape(-1, 4)
                at = self.upto(run[1], level, last)
                out.append(run[1][:at])
                run[1] = run[1][at:]
                if len(run[1]) or not at:
                    break
        return self.combined(np.concatenate(out)) if out else np.zeros((0, 4), np.int64)


def forward(most: int = HELD) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Adds to `leaves` and `saved` of each node those of all nodes below it that are in the shard.

    Nodes (depth, conv_id) come in descending order of depth, then ascending of conv_id; those that `sends` leave their sums for
    (to_depth, parent_conv_id).
    """
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queue = Queue(most)
        for frame in frames:
            if not len(frame):
                continue
            level, ids, to, up = (frame[c].to_numpy() for c in ("depth", "conv_id", "to_depth", "parent_conv_id"))
            sends, sums = frame["sends"].to_numpy(bool), np.array(frame[["leaves", "saved"]], np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(level[1:] != level[:-1]) + 1, [len(level)]]).tolist()
            for a, b in zip(cuts[:-1], cuts[1:]):
                got = queue.pop(-int(level[a]), int(ids[b - 1]))
                sums[a + np.searchsorted(ids[a:b], got[:, 1])] += got[:, 2:]
                go = a + np.flatnonzero(sends[a:b])
                queue.push(-to[go], up[go], sums[go, 0], sums[go, 1])
            yield frame.assign(leaves=sums[:, 0], saved=sums[:, 1])
    return work


def _passed(nodes: DataFrame, most: int) -> DataFrame:
    return nodes.sortWithinPartitions(F.desc("depth"), "conv_id").mapInPandas(forward(most), nodes.schema)


def _xor(c: str, *keys: str) -> Column:
    return F.bit_xor(c).over(Window.partitionBy(*keys).orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow))


def prefixes(turns: DataFrame, band: int = BAND) -> DataFrame:
    """conv_id, depth, key (kx, ky) of each prefix, key (ux, uy) of the one before, words, seg (its band)."""
    rows = turns.select("conv_id", "depth", F.xxhash64("depth", "a").alias("za"), F.xxhash64("b", "depth").alias("zb"), "words",
                        F.floor((F.col("depth") - 1) / band).alias("seg"))
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy("conv_id", "seg").agg(F.bit_xor("za").alias("za"), F.bit_xor("zb").alias("zb"))
               .select("conv_id", "seg", F.bit_xor("za").over(before).alias("ox"), F.bit_xor("zb").over(before).alias("oy")).where("seg > 0"))
    rows = rows.withColumn("kx", _xor("za", "conv_id", "seg")).withColumn("ky", _xor("zb", "conv_id", "seg")).join(offsets, ["conv_id", "seg"], "left")
    key = [F.col(k).bitwiseXOR(F.coalesce(o, F.lit(0).cast("long"))) for k, o in (("kx", "ox"), ("ky", "oy"))]
    return rows.select("conv_id", "depth", key[0].alias("kx"), key[1].alias("ky"), key[0].bitwiseXOR(F.col("za")).alias("ux"),
                       key[1].bitwiseXOR(F.col("zb")).alias("uy"), "words", "seg")


def _pieces(prefix: DataFrame, light: int) -> DataFrame:
    """Adds px, py: the key of the topmost node of the piece a node is in."""
    heavy = prefix.groupBy("depth", "kx", "ky").agg(F.count("*").alias("n")).where(F.col("n") > light).drop("n")
    down_to = prefix.select("conv_id", "depth", "kx", "ky").join(heavy, ["depth", "kx", "ky"]).groupBy("conv_id").agg(F.max("depth").alias("heavy_to"))
    rows = prefix.join(down_to, "conv_id", "left").withColumn("heavy_to", F.coalesce("heavy_to", F.lit(0)))
    run = Window.partitionBy("conv_id", "seg").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_light = F.col("depth") > F.col("heavy_to")
    tops = {p: F.when(is_light, F.first(F.when(is_light, F.col(k)), ignorenulls=True).over(run)).otherwise(F.first(k).over(run))
            for p, k in (("px", "kx"), ("py", "ky"))}
    return rows.select("*", *[c.alias(p) for p, c in tops.items()])


def _digests(ends: DataFrame, run_ids: int = RUN_IDS) -> DataFrame:
    """depth, kx, ky, ends_sha256 from rows of conv_id and the key of the node where it ends."""
    key = ["depth", "kx", "ky"]

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, runs = TaskContext.get().partitionId(), 0
        held, n = [], 0

        def run() -> pd.DataFrame:
            rows = pd.concat(held, ignore_index=True).assign(ids=lambda f: f["conv_id"].astype(str))
            return rows.groupby(key, sort=False)["ids"].agg(",".join).reset_index().assign(part=part, run=runs)

        for frame in frames:
            for a in range(0, len(frame), run_ids):
                held.append(frame.iloc[a:a + run_ids])
                n += len(held[-1])
                if n >= run_ids:
                    yield run()
                    held, n, runs = [], 0, runs + 1
        if n:
            yield run()

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sha = None, None
        for frame in frames:
            out = []
            for depth, kx, ky, ids in frame.itertuples(index=False):
                if (depth, kx, ky) == now:
                    sha.update(b",")
                else:
                    if now:
                        out.append((*now, sha.hexdigest()))
                    now, sha = (depth, kx, ky), hashlib.sha256()
                sha.update(ids.encode())
            yield pd.DataFrame(out, columns=[*key, "ends_sha256"])
        if now:
            yield pd.DataFrame([(*now, sha.hexdigest())], columns=[*key, "ends_sha256"])

    parts = width(ends.sparkSession)
    runs = (ends.select("conv_id", *key).repartitionByRange(parts, "conv_id").sortWithinPartitions("conv_id")
            .mapInPandas(packed, "depth long, kx long, ky long, ids string, part long, run long"))
    return (runs.repartition(*key).sortWithinPartitions(*key, "part", "run").select(*key, "ids")
            .mapInPandas(hashed, "depth long, kx long, ky long, ends_sha256 string"))


def _totals(nodes: DataFrame, most: int) -> DataFrame:
    """The nodes with the sums over whole subtrees."""
    local = written(_passed(nodes.repartition("px", "py"), most), "trie-local")
    top = local.where("not sends").select("px", "py", "qx", "qy", "conv_id", "depth", "parent_conv_id", "leaves", "saved")
    below = top.where("depth > 0")
    inner = below.select(F.col("qx").alias("px"), F.col("qy").alias("py")).distinct()
    # Roots of pieces with pieces below them, with what the others left.
    left = (below.join(inner, ["px", "py"], "left_anti").groupBy(F.col("qx").alias("px"), F.col("qy").alias("py"))
            .agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s")))
    roots = written(top.join(inner, ["px", "py"]).join(left, ["px", "py"], "left").withColumns({
        "leaves": F.col("leaves") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("s", F.lit(0))}).drop("l", "s"), "trie-roots")
    above = roots.select(F.col("px").alias("qx"), F.col("py").alias("qy"), F.col("depth").alias("to_depth"), F.col("conv_id").alias("to_conv"))
    tree = roots.join(above, ["qx", "qy"], "left").select(
        "px", "py", "qx", "qy", "conv_id", "depth", F.col("parent_conv_id").alias("up"), F.coalesce("to_conv", F.lit(0)).alias("parent_conv_id"),
        F.coalesce("to_depth", F.lit(0)).alias("to_depth"), (F.col("depth") > 0).alias("sends"), "leaves", "saved")
    whole = _passed(tree.repartition(1), most).where("depth > 0").select("qx", "qy", F.col("up").alias("conv_id"), (F.col("depth") - 1).alias("depth"), "leaves", "saved")
    others = below.join(inner, ["px", "py"], "left_anti").select("qx", "qy", F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"), "leaves", "saved")
    came = whole.unionByName(others).groupBy("conv_id", "depth").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    upper = local.join(inner, ["px", "py"]).join(came, ["conv_id", "depth"], "left").withColumns({
        "own_l": F.col("leaves"), "own_s": F.col("saved"), "leaves": F.coalesce("l", F.lit(0)), "saved": F.coalesce("s", F.lit(0))}).drop("l", "s")
    upper = _passed(upper.repartition("px", "py"), most).withColumns({
        "leaves": F.col("leaves") + F.col("own_l"), "saved": F.col("saved") + F.col("own_s")}).drop("own_l", "own_s")
    return local.join(inner, ["px", "py"], "left_anti").unionByName(upper)


def trie(turns: DataFrame, convs: DataFrame, light: int = LIGHT, band: int = BAND, held: int = HELD) -> DataFrame:
    """One row for each node of the trie of conversations.

    turns: conv_id, depth (1 to n_turns), a, b, words; convs: conv_id, n_turns, once each, also those without turns. Returns
    conv_id (least member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves (childless nodes of the subtree),
    saved_tokens (words of the last text times members but one, summed over the subtree), ends_sha256 (of the decimal ids
    of members that end there, ascending, joined by commas). Without conversations there are no rows.
    """
    convs = written(convs, "trie-convs")
    root = convs.agg(F.min("conv_id"), F.count("*")).first()
    if not root[1]:
        return convs.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    prefix = written(prefixes(turns, band), "trie-prefixes")
    zero = F.lit(0).cast("long")
    made = written(_pieces(prefix, light).groupBy("depth", "kx", "ky").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.max(c).alias(c) for c in ("words", "ux", "uy", "px", "py")]), "trie-nodes")
    children = made.groupBy((F.col("depth") - 1).alias("depth"), F.col("ux").alias("kx"), F.col("uy").alias("ky")).agg(F.count("*").alias("n_children"))
    first = made.where("depth = 1").select("*", F.lit(root[0]).alias("parent_conv_id"), zero.alias("qx"), zero.alias("qy"))
    up = made.select((F.col("depth") + 1).alias("depth"), F.col("kx").alias("ux"), F.col("ky").alias("uy"), F.col("conv_id").alias("parent_conv_id"),
                     F.col("px").alias("qx"), F.col("py").alias("qy"))
    deeper = made.where("depth > 1").join(up, ["depth", "ux", "uy"]).select(*first.columns)
    top = convs.sparkSession.range(1).select(
        zero.alias("depth"), zero.alias("kx"), zero.alias("ky"), F.lit(root[0]).alias("conv_id"), F.lit(root[1]).alias("n_convs"), zero.alias("words"),
        *[zero.alias(c) for c in ("ux", "uy", "px", "py")], F.lit(root[0]).alias("parent_conv_id"), zero.alias("qx"), zero.alias("qy"))
    nodes = first.unionByName(deeper).unionByName(top).join(children, ["depth", "kx", "ky"], "left").select(
        "conv_id", "depth", "kx", "ky", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "parent_conv_id", "px", "py", "qx", "qy",
        (F.col("depth") - 1).alias("to_depth"), ((F.col("depth") > 0) & (F.col("px") == F.col("qx")) & (F.col("py") == F.col("qy"))).alias("sends"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    ends = prefix.join(convs.select("conv_id", F.col("n_turns").alias("depth")), ["conv_id", "depth"]).select("conv_id", "depth", "kx", "ky")
    ends = ends.unionByName(convs.where("n_turns = 0").select("conv_id", zero.alias("depth"), zero.alias("kx"), zero.alias("ky")))
    return _totals(nodes, held).join(_digests(ends), ["depth", "kx", "ky"], "left").select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))
