"""N-gram Jaccard join by chosen paths (operator 7).

Texts are sets of hashed shingles of SHINGLE words. A run starts all sets in one node; a node splits a set by the
BRANCH tokens that come first in an order of tokens drawn for that node, so two similar sets share a child with a
probability near their similarity. A node of more than SMALL sets is split further unless its largest child keeps
most of it (its sets are alike; splitting gains nothing). The other nodes are leaves. A pair of similarity 0.8 is
missed by one run with a probability of at most MISS; runs are repeated until the target recall is reached.

The join gives classes: what links join, directly or over others. Inside a leaf that fits one block all pairs are
compared exactly. A large leaf costs about as much as it has sets:

1. A set with too many tokens that no other set of large leaves has can't have a link there and goes.
2. The sets of a sample with the most links are pivots; every set is compared with them, and those linked to the same
   pivot are one class without being compared with each other.
3. Only sets outside the largest class of the leaf are compared with all the others, in blocks; of those, only where
   the tokens that they can share at all allow a link.

Equal texts are one set. A pair that meets in several leaves is compared in that of the least key only, the largest
leaf, which both sets' lists of leaves tell. Tasks give, for each linked set, an edge to the least one of its part,
from which classes are formed by label propagation. Blocks are cut by sets and tokens, so very long texts fit. Sets are
written once, in buckets by their text: steps that need some of them shuffle the names of these, not all sets.

Links of a text are counted exactly inside its class, since a link never leaves one. One minus the similarity is a
metric: two sets whose distances from a third add up to a fifth at most are linked, two whose distances differ by
more aren't. So the sets of a large class are put in bands by the distance from a middle one; of most bands this tells
whether all their pairs are links or none, and only the other bands are compared, in blocks. There a set goes as its
difference from the middle one, which is short for near copies and tells intersections as well as the set does."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
RECALL = 0.9999  # of pairs of similarity 0.8, over all runs
MISS = 0.07  # of one run
BRANCH = 2
FIRST_DEPTH = 2  # levels that are split before nodes are counted
MAX_DEPTH = 7
SMALL = 64
BLOCK = 512  # sets of a task, where a set counts for one and for each TOKENS of its tokens once more
TOKENS = 4096
PIVOTS = 16
ALIKE = 0.6  # share of a node in its largest child from which it is a leaf
SIMILAR = (4, 5)  # at least 4/5
COLUMNS = 8192  # of shingles that a comparison takes at once
LARGEST = (1 << 15) - 1  # sizes of leaves count up to here in their order
CACHED_WORDS = 200_000
BANDS = 200  # of distances from 0 to 1
REACH = BANDS // 5  # bands in the distance of a link

WORDS = re.compile(common.SPACE_WORD)
_M1, _M2, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class Shingles:
    """Texts as sorted sets of hashed shingles; words' hashes are kept for the next texts."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        """A text of one to four words is one shingle; one without words has none."""
        words = WORDS.findall(text or "")
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        row = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(SHINGLE, len(words))
        n = len(words) - width + 1
        key = np.full(n, width, np.uint64)
        for k in range(width):
            key = key * _STEP + row[k : k + n]
        return np.unique(mixed(key))


def children(nodes: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """For each node, the keys of the children of a set: a row of BRANCH, or fewer if the set has fewer tokens."""
    order = mixed(tokens[None, :] ^ nodes[:, None])
    k = min(BRANCH, len(tokens))
    at = np.argpartition(order, k - 1, axis=1)[:, :k] if k < len(tokens) else np.broadcast_to(np.arange(k), (len(nodes), k))
    return mixed(nodes[:, None] * _STEP + np.take_along_axis(order, at, 1))


def runs_for(recall: float) -> int:
    """Runs until a pair of similarity 0.8 is missed with a probability of at most 1 - recall."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(MISS) - 1e-9))


def first_paths(tokens: np.ndarray, runs: int) -> np.ndarray:
    nodes = mixed(np.arange(1, runs + 1, dtype=np.uint64) * _STEP)
    for _ in range(FIRST_DEPTH):
        nodes = children(nodes, tokens).ravel()
    return nodes


def runs_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows, sorted by their first columns, as lists of those that agree in them; a list may span batches."""
    group: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and group[-1][:keys] != row[:keys]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def grouped(df: DataFrame, keys: list[str], make: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """df dealt out by keys; make gets the rows of one key after the other, keys first, and gives rows of schema."""
    common.small_batches(df.sparkSession)
    names = [part.split()[0] for part in schema.split(", ")]
    rows = df.select(*keys, *(c for c in df.columns if c not in keys)).repartition(*keys).sortWithinPartitions(*keys)
    types = rows.sparkSession.createDataFrame([], schema).schema
    arrow = pa.schema([pa.field(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t.dataType.simpleString().replace("bigint", "long")]) for n, t in zip(names, types, strict=True)])

    def run(batches):
        out: list[tuple] = []
        for group in runs_of(batches, len(keys)):
            out += make(group)
            if len(out) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, types)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left set with each right one, by products of presence matrices over slices
    of the tokens that both sides have."""
    tokens = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(tokens):
        return out

    def places(sets):
        owner, flat = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(tokens, flat), len(tokens) - 1)
        found = tokens[at] == flat
        return owner[found], at[found]

    sides = [(*places(left), len(left)), (*places(right), len(right))]
    for at in range(0, len(tokens), COLUMNS):
        width = min(COLUMNS, len(tokens) - at)
        presence = []
        for owner, column, n in sides:
            part = (column >= at) & (column < at + width)
            presence.append(np.zeros((n, width), np.float32))
            presence[-1][owner[part], column[part] - at] = 1
        out += presence[0] @ presence[1].T
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which left sets are similar to which right ones, exactly."""
    both, union = similarity(left, right)
    return SIMILAR[1] * both >= SIMILAR[0] * union


def stars(tids: list[bytes], links: np.ndarray) -> list[tuple[bytes, bytes]]:
    """links between sets (a square) -> (tid, least tid of its part) of every set with a link to another."""
    links = links | links.T
    order = sorted(range(len(tids)), key=lambda i: tids[i])
    links = links[np.ix_(order, order)]
    np.fill_diagonal(links, False)
    n = len(order)
    label = np.arange(n)
    while True:
        least = np.minimum(label, np.where(links, label[None, :], n).min(1, initial=n))
        least = least[least]
        if (least == label).all():
            break
        label = least
    return [(tids[i], tids[order[k]]) for i, k, some in zip(order, label.tolist(), links.any(1).tolist(), strict=True) if some]


def choose_pivots(group: list[tuple]) -> list[tuple]:
    """(key, tid, tokens) of a sample of a leaf -> (key, tid) of the sets that cover most of it by their links."""
    if len(group) < 2:
        return []
    links = linked(*[[np.frombuffer(g[2], np.uint64) for g in group]] * 2)
    open_, chosen = links.sum(1) > 1, []
    for _ in range(PIVOTS):
        gain = links[:, open_].sum(1)
        best = int(gain.argmax())
        if gain[best] < 2:
            break
        chosen.append((group[best][0], group[best][1]))
        open_ &= ~links[best]
    return chosen


def assign(group: list[tuple]) -> list[tuple]:
    """(key, block, pivot, tid, tokens) of one block and the pivots of its leaf -> (tid, root)."""
    pivots = [g for g in group if g[2]]
    known = {g[3] for g in pivots}
    rows = pivots + [g for g in group if not g[2] and g[3] not in known]
    if not pivots:
        return []
    sets = [np.frombuffer(g[4], np.uint64) for g in rows]
    links = np.zeros((len(rows), len(rows)), bool)
    links[:, : len(pivots)] = linked(sets, sets[: len(pivots)])
    return stars([g[3] for g in rows], links)


def sides(group: list[tuple], role: int) -> tuple[list[int], list[int]]:
    """Places of the sets of the block (role 0) and of those that are compared with them (1); 2 is both."""
    return [i for i, g in enumerate(group) if g[role] != 1], [i for i, g in enumerate(group) if g[role] != 0]


def propose(group: list[tuple]) -> list[tuple]:
    """(key, block, other, role, rest, tid, size, most, label, leaves) of one task -> its sets with a pair to compare.

    rest tells sets that are compared with all others: of two of them the pair is taken once. most is the number of
    tokens that a set can share with others here."""
    key, block, other = group[0][:3]
    left, right = sides(group, 3)
    if not left or not right:
        return []
    at = np.arange(len(group))
    tids = [g[5] for g in group]
    names: dict[bytes, int] = {}
    label = np.array([names.setdefault(g[8] or g[5], len(names)) for g in group])
    rank = np.empty(len(group), np.int64)
    rank[sorted(at.tolist(), key=lambda i: tids[i])] = at
    size, most, rest = (np.array([g[c] for g in group], np.int64) for c in (6, 7, 4))
    a, b = np.array(left)[:, None], np.array(right)[None, :]
    mine = (label[a] != label[b]) & ((rest[a] == 0) | (rank[b] < rank[a]))
    mine &= SIMILAR[1] * np.minimum(size[a], size[b]) >= SIMILAR[0] * np.maximum(size[a], size[b])
    mine &= sum(SIMILAR) * np.minimum(most[a], most[b]) >= SIMILAR[0] * (size[a] + size[b])
    places: dict[int, int] = {}
    lesser = [[places.setdefault(k, len(places)) for k in g[9] if k < key] for g in group]
    if places and mine.any():
        has = np.zeros((len(group), len(places)), np.float32)
        for i, keys in enumerate(lesser):
            has[i, keys] = 1
        mine &= has[left] @ has[right].T == 0
    out = []
    some = np.zeros((len(group), 2), bool)
    some[left, 0], some[right, 1] = mine.any(1), mine.any(0)
    for g, (of_block, compared) in zip(group, some.tolist(), strict=True):
        if of_block or compared:
            out.append((key, block, other, 2 if of_block and compared else int(compared), g[5]))
    return out


def verify(group: list[tuple]) -> list[tuple]:
    """(key, block, other, role, tid, tokens) of one task -> (tid, root) of the links found."""
    left, right = sides(group, 3)
    if not left or not right:
        return []
    sets = [np.frombuffer(g[5], np.uint64) for g in group]
    links = np.zeros((len(group), len(group)), bool)
    links[np.ix_(left, right)] = linked([sets[i] for i in left], [sets[i] for i in right])
    return stars([g[4] for g in group], links)


def components(edges: DataFrame) -> DataFrame:
    """edges (tid, root) -> (tid, label), the least tid of each component, by propagation with pointer jumping."""
    both = common.stage(edges.where("tid <> root").select("tid", "root").unionByName(edges.where("tid <> root").select(F.col("root").alias("tid"), F.col("tid").alias("root"))).distinct(), "edges")
    labels = common.stage(both.groupBy("tid").agg(F.min("root").alias("__m")).select("tid", F.least("tid", "__m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("tid", "root"), "root").groupBy("tid").agg(F.min("label").alias("__near"))
        moved = labels.join(near, "tid", "left").select("tid", F.col("label").alias("__old"), F.least("label", "__near").alias("__new"))
        moved = common.stage(moved, "labels")
        named = moved.select(F.col("__new").alias("tid")).distinct()
        jump = moved.join(named, "tid", "left_semi").where("tid <> __new").select(F.col("tid").alias("__new"), F.col("__new").alias("__jump"))
        moved = common.join_params(moved, common.stage(jump, "jumps"), "__new")  # labels that have got another label
        moved = common.stage(moved.select("tid", "__old", F.coalesce("__jump", "__new").alias("label")), "labels")
        if moved.where(F.col("__old") != F.col("label")).isEmpty():
            return moved.select("tid", "label")
        labels = moved.select("tid", "label")


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows of keys that more than one row has, with n, their number; those of hot keys aren't gathered."""
    counts = common.stage(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), "counts")
    return common.join_hot(rows, counts, key, "n")


def leaves_of(level: DataFrame, sets: DataFrame, small: int = SMALL) -> DataFrame:
    """level (key, tid, n): nodes with more than one set -> the leaves (key, tid, n) below or at them."""
    found = level.where(F.col("n") <= small)
    big = common.stage(level.where(F.col("n") > small), "nodes")

    def make():
        def step(keys, tokens):
            out = []
            for own, raw in zip(keys, tokens, strict=True):
                nodes = np.array(own, np.int64).view(np.uint64)
                out.append([{"parent": p, "child": c} for p, row in zip(own, children(nodes, np.frombuffer(raw, np.uint64)).view(np.int64).tolist(), strict=True) for c in row])
            return [out]

        return step

    for depth in range(FIRST_DEPTH + 1, MAX_DEPTH + 1):
        if big.isEmpty():
            return found
        gathered = big.groupBy("tid").agg(F.collect_list("key").alias("keys")).join(sets.select("tid", "tokens"), "tid")
        split = common.map_columns(gathered, ["keys", "tokens"], make, "made array<struct<parent:long,child:long>>")
        split = common.stage(split.select("tid", F.explode("made").alias("m")).select("tid", "m.parent", "m.child"), "nodes")
        counts = split.groupBy("parent", "child").agg(F.count("*").alias("n"))
        sizes = big.groupBy("key").agg(F.first("n").alias("__whole")).withColumnRenamed("key", "parent")
        alike = counts.groupBy("parent").agg(F.max("n").alias("__most")).join(sizes, "parent").where(F.col("__most") >= ALIKE * F.col("__whole")).select(F.col("parent").alias("key"))
        alike = common.stage(alike.withColumn("__stop", F.lit(True)), "alike")  # nodes of more than small sets: few beside the rows
        found = found.unionByName(common.join_params(big, alike, "key").where("__stop").drop("__stop"))
        go_on = common.join_params(split.withColumnRenamed("parent", "key"), alike, "key").where("__stop IS NULL").select(F.col("child").alias("key"), "tid").distinct()
        following = common.stage(numbered(common.stage(go_on, "nodes"), "key"), "nodes")
        found = found.unionByName(following.where(F.col("n") <= small))
        big = following.where(F.col("n") > small)
    return found.unionByName(big)  # the last ones are compared as they are


def by_size(key: Column, n: Column) -> Column:
    """Keys of leaves in the order of their size, the largest first, then of their hash. The pairs of a group of near
    copies then mostly belong to one leaf, and fewer sets are sent to others."""
    rank = F.lit(LARGEST) - F.least(n, F.lit(LARGEST))
    return F.shiftleft(rank.cast("long"), 48).bitwiseOR(F.shiftrightunsigned(key, 16))


def single_tokens(sets: DataFrame) -> DataFrame:
    """sets (tid, high, low, tokens) -> (high, low, single): how many tokens of a set no other of these sets has."""

    def flat(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, common.ROWS_PER_SLICE):
                batch = whole.slice(at, common.ROWS_PER_SLICE)
                tokens = [np.frombuffer(t, np.int64) for t in batch.column(2).to_pylist()]
                owner = pa.array(np.repeat(np.arange(len(tokens)), [len(t) for t in tokens]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array(np.concatenate(tokens))], names=["high", "low", "token"])

    common.small_batches(sets.sparkSession)
    rows = sets.select("high", "low", "tokens").mapInArrow(flat, "high long, low long, token long")
    once = rows.groupBy("token").agg(F.count("*").alias("n"), F.min("high").alias("high"), F.min("low").alias("low")).where("n = 1")
    return once.groupBy("high", "low").agg(F.count("*").alias("single"))


def weighed(leaves: DataFrame) -> DataFrame:
    """leaves (key, tid, size ...) with weight, the sum over the leaf of what its sets count for."""
    sums = common.stage(leaves.groupBy("key").agg(F.sum(load_of("size")).alias("weight"), F.count("*").alias("n")).where("n > 1"), "weights")
    return common.join_hot(leaves, sums, "key", "n").drop("n")


def load_of(size: str) -> Column:
    return 1 + F.col(size) / TOKENS


def pieces(weight: str) -> Column:
    return F.ceil(F.col(weight) / BLOCK).cast("int")


def without_lone_sets(leaves: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """leaves (key, tid, size) -> leaves (key, tid, size, most, weight) without the sets of large leaves that can't
    have a link there, and those of them that are still large.

    most tokens of a set are in other sets of large leaves. Two linked sets of sizes a and b share 4/9 of a + b at
    least; a leaf's profile has the largest most of its sets by size, in steps of size of a fiftieth."""
    leaves = common.stage(weighed(leaves), "leaves")
    members = sets.join(leaves.where(F.col("weight") > BLOCK).select("tid").distinct(), "tid")
    single = common.stage(members.select("tid", "high", "low").join(single_tokens(members), ["high", "low"]).select("tid", "single"), "single")
    large = leaves.where(F.col("weight") > BLOCK).join(single, "tid", "left").withColumn("most", F.col("size") - F.coalesce("single", F.lit(0))).drop("single")
    large = common.stage(large, "large-leaves")
    steps = large.groupBy("key", F.floor(F.log("size") * 50).alias("step")).agg(F.min("size").alias("low"), F.max("size").alias("high"), F.max("most").alias("most"))
    profiles = common.stage(steps.groupBy("key").agg(F.collect_list(F.struct("low", "high", "most")).alias("profile")), "profiles")
    size, most = F.col("size"), F.col("most")
    near = lambda p: (SIMILAR[1] * p["high"] >= SIMILAR[0] * size) & (SIMILAR[0] * p["low"] <= SIMILAR[1] * size)
    linkable = F.exists("profile", lambda p: near(p) & (sum(SIMILAR) * F.least(most, p["most"]) >= SIMILAR[0] * (size + p["low"])))
    kept = common.join_params(large, profiles, "key", rows=2000, salts=8).where(linkable).select("key", "tid", "size", "most")
    small = leaves.where(F.col("weight") <= BLOCK).select("key", "tid", "size", F.col("size").cast("long").alias("most"))
    kept = common.stage(weighed(kept.unionByName(small)), "leaves")
    return kept, kept.where(F.col("weight") > BLOCK)


def pivot_links(large: DataFrame, sets: DataFrame) -> DataFrame:
    """large leaves (key, tid, size, weight) -> (tid, root): links to the pivots of the largest leaf of each set."""
    home = large.groupBy("tid").agg(F.min_by(F.struct("key", "size", "weight"), "key").alias("m")).select("tid", "m.key", "m.size", "m.weight")
    home = common.stage(home, "homes")
    drawn = F.pmod(F.xxhash64("tid", "key"), F.ceil(F.col("weight") * load_of("size"))) < BLOCK
    tokens = sets.select("tid", "tokens")
    sample = home.where(drawn).join(tokens, "tid").select("key", "tid", "tokens")
    pivots = common.stage(grouped(sample, ["key"], choose_pivots, "key long, tid binary"), "pivots")
    blocks = home.groupBy("key").agg(F.first("weight").alias("weight"))
    dealt = pivots.join(blocks, "key").join(tokens, "tid").withColumn("block", F.explode(F.sequence(F.lit(0), pieces("weight") - 1)))
    dealt = dealt.select("key", "block", F.lit(1).alias("pivot"), "tid", "tokens")
    rows = home.withColumn("block", F.pmod(F.xxhash64("tid"), pieces("weight")).cast("int")).join(tokens, "tid")
    rows = rows.select("key", "block", F.lit(0).alias("pivot"), "tid", "tokens")
    return common.stage(grouped(rows.unionByName(dealt), ["key", "block"], assign, "tid binary, root binary"), "pivot-links")


def tasks_of(leaves: DataFrame, known: DataFrame) -> DataFrame:
    """leaves (key, tid, size, most, weight, leaves) and classes known so far (tid, label) -> tasks (key, block, other,
    role, rest, tid, size, most, label, leaves): in a leaf of one block all sets, in a larger one those outside its largest class
    with all the others. Rows of a leaf are its sets times the blocks of such outsiders, and outsiders times blocks."""
    rows = leaves.join(known, "tid", "left")
    columns = ["rest", "tid", "size", "most", "label", "leaves"]
    single = rows.where(F.col("weight") <= BLOCK).select("key", F.lit(0).alias("block"), F.lit(0).alias("other"), F.lit(2).alias("role"), F.lit(1).alias("rest"), *columns[1:])
    large = rows.where(F.col("weight") > BLOCK)
    parts = large.groupBy("key", "label").agg(F.sum(load_of("size")).alias("w"))
    named = F.when(F.col("label").isNotNull(), F.struct("w", "label"))
    parts = parts.groupBy("key").agg(F.sum("w").alias("__all"), F.max(named).alias("m")).select("key", F.col("m.label").alias("largest"), (F.col("__all") - F.coalesce("m.w", F.lit(0.0))).alias("outside"))
    large = common.join_params(large, common.stage(parts, "parts"), "key").withColumn("rest", (~F.coalesce(F.col("label") == F.col("largest"), F.lit(False))).cast("int"))
    others = F.greatest(F.lit(0), F.ceil((F.col("outside") - 1e-6) / BLOCK)).cast("int")
    own, split = F.pmod(F.xxhash64("tid"), pieces("weight")).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    large = large.withColumn("others", others).where("others > 0")
    inner = large.select("key", own.alias("block"), split(F.col("others")).alias("other"), F.lit(0).alias("role"), *columns)
    outer = large.where("rest = 1").select("key", split(pieces("weight")).alias("block"), F.pmod(F.xxhash64("tid", F.lit(1)), F.col("others")).cast("int").alias("other"), F.lit(1).alias("role"), *columns)
    return single.unionByName(inner).unionByName(outer)


def similarity(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the intersections and of the unions of each left set with each right one."""
    both = np.rint(shared_counts(left, right)).astype(np.int64)
    return both, np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :] - both


def middle(group: list[tuple]) -> list[tuple]:
    """(label, tid, tokens) of a sample of a class -> (label, tid) of the set that is nearest to all of them."""
    both, union = similarity(*[[np.frombuffer(g[2], np.uint64) for g in group]] * 2)
    return [group[int((both / union).sum(1).argmax())][:2]]


def bands(group: list[tuple]) -> list[tuple]:
    """(label, block, middle, tid, tokens) of one block and the middle set of its class -> (tid, band of the distance,
    tokens that only one of the set and the middle one has)."""
    centre = [np.frombuffer(g[4], np.uint64) for g in group if g[2]]
    rows = [(g[3], np.frombuffer(g[4], np.uint64)) for g in group if not g[2]]
    out = []
    for tid, tokens in rows:
        apart = np.setxor1d(tokens, centre[0], assume_unique=True)
        union = (len(tokens) + len(centre[0]) + len(apart)) // 2
        out.append((tid, BANDS * len(apart) // union, apart.tobytes()))
    return out


def count_links(group: list[tuple], at: int) -> list[tuple]:
    """Rows of one task, with side, tid, size and apart from column at on -> (tid, number of its links in the task). apart
    is what the set and one that all rows of the task have in common don't share (that may be the empty set, then
    apart is the set). Side 2 is both sides: all pairs of the rows; else those of rows of side 0 and 1."""
    left, right = sides(group, at)
    if not left or not right:
        return []
    apart = [np.frombuffer(g[at + 3], np.uint64) for g in group]
    size, differ = np.array([g[at + 2] for g in group], np.int64), np.array([len(a) for a in apart], np.int64)
    shared = np.rint(shared_counts([apart[i] for i in left], [apart[i] for i in right])).astype(np.int64)
    whole = size[left][:, None] + size[right][None, :]
    both = (whole - differ[left][:, None] - differ[right][None, :]) // 2 + shared
    links = SIMILAR[1] * both >= SIMILAR[0] * (whole - both)
    if left == right:
        np.fill_diagonal(links, False)
        return [(g[at + 1], n) for g, n in zip(group, links.sum(1).tolist(), strict=True) if n]
    ends = [*zip(left, links.sum(1).tolist(), strict=True), *zip(right, links.sum(0).tolist(), strict=True)]
    return [(group[i][at + 1], n) for i, n in ends if n]


def banded(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """Sets of large classes (label, tid, size, weight, least) -> (label, tid, size, band, apart) by the distance and the
    difference from a middle set of the class, which is chosen in a sample of one block and the least tid."""
    drawn = F.pmod(F.xxhash64("tid", "label"), F.ceil(F.col("weight") * load_of("size"))) < BLOCK
    sample = rows.where(drawn | (F.col("tid") == F.col("least"))).join(tokens, "tid").select("label", "tid", "tokens")
    centres = common.stage(grouped(sample, ["label"], middle, "label binary, tid binary"), "middles")
    weights = rows.groupBy("label").agg(F.first("weight").alias("weight"))
    dealt = centres.join(weights, "label").join(tokens, "tid").withColumn("block", F.explode(F.sequence(F.lit(0), pieces("weight") - 1)))
    own = rows.withColumn("block", F.pmod(F.xxhash64("tid"), pieces("weight")).cast("int")).join(tokens, "tid")
    columns = ["label", "block", "middle", "tid", "tokens"]
    both = own.withColumn("middle", F.lit(0)).select(columns).unionByName(dealt.withColumn("middle", F.lit(1)).select(columns))
    found = grouped(both, ["label", "block"], bands, "tid binary, band int, apart binary")
    return common.stage(rows.select("label", "tid", "size").join(found, "tid"), "bands")


def band_groups(rows: DataFrame) -> DataFrame:
    """rows (label, band, size) -> (key, sure, partners, group, pieces) by key, a label and band: neighbouring bands are
    one group of about a block. sure is the number of sets that all sets of the group are linked to, partners are the groups
    with which they must be compared. A class has BANDS + 1 bands at most, so no window or join here grows with it."""
    loads = rows.groupBy("label", "band").agg(F.sum(load_of("size")).alias("w"), F.count("*").alias("n"))
    before = F.sum("w").over(Window.partitionBy("label").orderBy("band").rowsBetween(Window.unboundedPreceding, -1))
    part = F.struct((2 * F.col("band") + 2 > REACH).alias("far"), F.floor(F.coalesce(before, F.lit(0.0)) / BLOCK).alias("at"))
    loads = common.stage(loads.withColumn("part", part), "loads")
    groups = loads.groupBy("label", "part").agg(F.min("band").alias("low"), F.max("band").alias("high"), F.sum("w").alias("weight"), F.sum("n").alias("n"))
    groups = common.stage(groups.withColumn("pieces", pieces("weight")), "groups")
    other = groups.select("label", *(F.col(c).alias(f"other_{c}") for c in ("low", "high", "n", "pieces")))
    sure = F.col("high") + F.col("other_high") + 2 <= REACH
    apart = F.greatest(F.col("other_low") - F.col("high"), F.col("low") - F.col("other_high")) - 1 >= REACH
    mates = F.col("other_n") - (F.col("low") == F.col("other_low")).cast("long")
    met = groups.join(other, "label").groupBy("label", "part", F.col("low").alias("group"), "pieces").agg(
        F.coalesce(F.sum(F.when(sure, mates)), F.lit(0)).alias("sure"),
        F.collect_list(F.when(~sure & ~apart, F.struct(F.col("other_low").alias("group"), F.col("other_pieces").alias("pieces")))).alias("partners"),
    )
    named = loads.select("label", "part", F.struct("label", "band").alias("key")).join(met, ["label", "part"])
    return common.stage(named.select("key", "sure", "partners", "group", "pieces"), "band-groups")


def link_counts(members: DataFrame, sets: DataFrame) -> DataFrame:
    """members (label, tid) of classes of several texts -> (tid, n_links): with how many other texts of its class a text
    has a similarity of at least 0.8, exactly."""
    rows = members.join(sets.select("tid", "size"), "tid")
    sums = rows.groupBy("label").agg(F.sum(load_of("size")).alias("weight"), F.count("*").alias("n"), F.min("tid").alias("least"))
    rows = common.stage(common.join_hot(rows, common.stage(sums, "class-weights"), "label", "n"), "class-members")
    tokens = sets.select("tid", "tokens")
    few = rows.where(F.col("weight") <= BLOCK).join(tokens, "tid").select("label", F.lit(2).alias("side"), "tid", "size", F.col("tokens").alias("apart"))
    counted = grouped(few, ["label"], lambda g: count_links(g, 1), "tid binary, n_links long")

    large = rows.where(F.col("weight") > BLOCK)
    if not large.isEmpty():
        placed = banded(large, tokens)
        placed = common.join_params(placed.withColumn("key", F.struct("label", "band")), band_groups(placed), "key")
        placed = placed.withColumn("piece", F.pmod(F.xxhash64("tid"), F.col("pieces")).cast("int"))
        placed = common.stage(placed.select("label", "tid", "size", "apart", "sure", "partners", "group", "piece"), "placed")
        blocks = F.transform("partners", lambda p: F.transform(F.sequence(F.lit(0), p["pieces"] - 1), lambda q: F.struct(p["group"].alias("group"), q.alias("piece"))))
        asked = placed.where(F.size("partners") > 0).select("label", F.struct("group", "piece").alias("own"), F.explode(F.flatten(blocks)).alias("other"), "tid", "size", "apart")
        side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
        pair = [F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")]
        asked = asked.select("label", *pair, side.alias("side"), "tid", "size", "apart").select("label", "a.group", "a.piece", F.col("b.group").alias("group_b"), F.col("b.piece").alias("piece_b"), "side", "tid", "size", "apart")
        compared = grouped(asked, ["label", "group", "piece", "group_b", "piece_b"], lambda g: count_links(g, 5), "tid binary, n_links long")
        counted = counted.unionByName(compared).unionByName(placed.select("tid", F.col("sure").alias("n_links")))
    return common.stage(counted.groupBy("tid").agg(F.sum("n_links").alias("n_links")), "link-counts")


def near_duplicates(docs: DataFrame, recall: float = RECALL, links: bool = False) -> DataFrame:
    """One row a row of docs: doc_id, class_id (the least doc_id of all that links of a similarity of at least 0.8 join),
    class_size and n_texts (documents and different texts of the class), text_id (of equal texts), label (a text_id
    that all rows of a class and no others have; null without words). With links, also n_links, the number of different
    texts that the row's text is linked to; equal texts don't count.

    Texts without words, null ones too, link to nothing: they are their own class. Rows with equal or null doc_id
    stay apart; class_id is null only where no row of the class has a doc_id. Other columns of docs are left out."""
    runs = runs_for(recall)

    def make():
        shingles = Shingles()

        def step(texts):
            out = []
            for text in texts:
                tokens = shingles.of(text)
                out.append(first_paths(tokens, runs).view(np.int64).tolist() if len(tokens) else [])
            return [out]

        return step

    def make_sets():
        shingles = Shingles()

        def step(texts, tids):
            sets = [shingles.of(t) for t in texts]
            halves = np.frombuffer(b"".join(tids), np.int64).reshape(-1, 2)
            return [[s.tobytes() for s in sets], [len(s) for s in sets], *halves.T.tolist()]

        return step

    source = docs.select("doc_id", "text").withColumn("tid", F.unhex(F.md5("text")))
    rows = common.stage(common.map_columns(source, ["text"], make, "keys array<long>").select("doc_id", "tid", "keys"), "paths")
    texts = rows.where(F.size("keys") > 0).groupBy("tid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("keys").alias("keys"))
    texts = common.stage(texts, "texts")

    level = common.stage(numbered(texts.select(F.explode(F.array_distinct("keys")).alias("key"), "tid"), "key"), "nodes")
    met = texts.select("tid", "rep").join(level.select("tid").distinct(), "tid", "left_semi")
    one = source.alias("s").join(common.small(met).alias("m"), (F.col("s.tid") == F.col("m.tid")) & F.col("s.doc_id").eqNullSafe(F.col("m.rep"))).select("s.tid", "s.text")
    made = common.map_columns(one, ["text", "tid"], make_sets, "tokens binary, size int, high long, low long")
    sets = common.stage_by(made.select("tid", "tokens", "size", "high", "low").dropDuplicates(["tid"]), "sets", "tid")

    leaves = leaves_of(level, sets).withColumn("key", by_size(F.col("key"), F.col("n"))).select("key", "tid").distinct()
    leaves, large = without_lone_sets(leaves.join(sets.select("tid", "size"), "tid"), sets)
    to_pivots = pivot_links(large, sets)
    known = components(to_pivots)
    lists = leaves.groupBy("tid").agg(F.collect_list("key").alias("leaves"))
    task = ["key", "block", "other"]
    asked = tasks_of(leaves.join(lists, "tid"), known).select(*task, "role", "rest", "tid", "size", "most", "label", "leaves")
    proposed = common.stage(grouped(asked, task, propose, "key long, block int, other int, role int, tid binary"), "proposed")
    compared = grouped(proposed.join(sets.select("tid", "tokens"), "tid").select(*task, "role", "tid", "tokens"), task, verify, "tid binary, root binary")
    labels = components(common.stage(to_pivots.unionByName(compared), "links"))

    named = common.stage(texts.join(labels, "tid", "left").select("tid", "rep", "copies", F.coalesce("label", "tid").alias("label")), "named")
    classes = common.stage(named.groupBy("label").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"), F.count("*").alias("n_texts")), "classes")
    known = common.join_hot(named, classes, "label", "n_texts").select("tid", "class_id", "class_size", "n_texts", "label", "copies")
    more = []
    if links:
        known = common.stage(known, "known")
        counts = link_counts(known.where("n_texts > 1").select("label", "tid"), sets)
        known, more = known.join(counts, "tid", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0))), ["n_links"]
    worded = common.join_hot(rows.where(F.size("keys") > 0).select("doc_id", "tid"), common.stage(known, "known"), "tid", "copies")
    wordless = rows.where(F.size("keys") == 0).select("doc_id", "tid", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(1).cast("long").alias("n_texts"), F.lit(None).cast("binary").alias("label"))
    out = worded.drop("copies").unionByName(wordless.withColumns({c: F.lit(0).cast("long") for c in more}))
    return out.select("doc_id", "class_id", "class_size", "n_texts", *more, F.col("tid").alias("text_id"), "label")


def op7_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of all documents and their numbers of links: doc_id, class_id, class_size, n_texts, n_links."""
    return near_duplicates(common.load(spark, sf_dir, "documents"), links=True).drop("text_id", "label")


SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all(coalesce(text, ''), '{common.SPACE_WORD}') AS w FROM documents),
g AS (SELECT DISTINCT r, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS t FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - {SHINGLE - 1}) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS k FROM g GROUP BY r),
met AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM g a JOIN g b ON a.t = b.t AND a.r <> b.r GROUP BY 1, 2),
links AS (SELECT x, y FROM met JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 5 * met.k >= 4 * (a.k + b.k - met.k)),
reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
classes AS (SELECT reach.x AS r, min(d.doc_id) AS class_id, count(*) AS class_size, greatest(1, count(DISTINCT d.text)) AS n_texts FROM reach JOIN d ON d.r = reach.y GROUP BY 1),
counts AS (SELECT x AS r, count(DISTINCT b.text) AS n_links FROM links JOIN d a ON a.r = x JOIN d b ON b.r = y WHERE a.text <> b.text GROUP BY 1)
SELECT doc_id, class_id, class_size, n_texts, coalesce(n_links, 0) AS n_links FROM d JOIN classes USING (r) LEFT JOIN counts USING (r)
"""
