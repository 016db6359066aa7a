"""Near-duplicate groups: MinHash bands, odd sketches to sift candidates, full sets to confirm them."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, stage, table
from .components import components

BANDS, ROWS = 24, 5
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch.
BITS = 512
#: A pair is checked on full sets from this estimated similarity on: over four deviations under 0.8.
SIFT = 0.62
#: Members of a bucket compared in one group; larger buckets are cut into pairs of blocks.
BLOCK = 2048
#: Pairs of one node that meet its set in one group; a node of more has its set copied to as many groups.
CHUNK = 512
#: A block of a family has nodes of this weight: their sets' hashes, and LEAST for each, so that small sets are bounded in number.
WEIGHT, LEAST = 1 << 19, 256
#: A family of more blocks is compared as a whole if that is at most as many comparisons for each of its sifted pairs.
DENSE = 64
#: Comparisons by matrix product at the cost of one pair counted by itself; hashes in a product, and pairs counted at a time.
RARE, SLICE, EXPANDED = 160, 4096, 2_000_000
#: Rows of an id and two nodes (about 100 bytes each) up to which those whose sets are needed are broadcast.
MOST_WANTED = 1_000_000
VOCAB = 500_000

_rng = np.random.default_rng(20240229)
_A = _rng.integers(1 << 31, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Vocab(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= VOCAB:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


class Shingles:
    """Sorted distinct 64-bit shingle hashes of a text."""

    def __init__(self, width: int = 2):
        self.width, self.vocab = width, _Vocab()

    def of(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
        if not words:
            return np.empty(0, np.uint64)
        h = np.array([self.vocab[w] for w in words], np.uint64)
        n = min(self.width, len(h))
        x = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            x = _mix(x * _C1 + h[k : len(h) - n + 1 + k] + _C2)
        return np.unique(x)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (int64) and odd sketches (uint64 words) of non-empty sets."""
    n, flat = len(sets), (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    low = np.empty((n, SAMPLES), np.uint64)
    for k in range(SAMPLES):
        low[:, k] = np.minimum.reduceat(flat * _A[k] + _B[k], starts)
    bands = np.empty((n, BANDS), np.uint64)
    for b in range(BANDS):
        x = np.full(n, b + 1, np.uint64)
        for r in range(ROWS):
            x = _mix(x * _C1 + low[:, b * ROWS + r] + _C2)
        bands[:, b] = x
    where = _mix(low * _C2 + np.arange(SAMPLES, dtype=np.uint64) * _C1) % np.uint64(BITS)
    flips = np.bincount((where + np.arange(n, dtype=np.uint64)[:, None] * np.uint64(BITS)).ravel().astype(np.int64), minlength=n * BITS) & 1
    return bands.view(np.int64), np.packbits(flips.astype(np.uint8)).reshape(n, BITS // 8).view(np.uint64)


def estimate(odd: np.ndarray) -> np.ndarray:
    """Similarity from the number of bits in which two odd sketches differ."""
    part = np.minimum(2.0 * odd / BITS, 1 - 1e-9)
    return 1 + BITS / 2 * np.log1p(-part) / (2 * SAMPLES)


#: Most differing bits with an estimate of SIFT or more.
MOST_BITS = int(np.flatnonzero(estimate(np.arange(BITS + 1)) >= SIFT).max())


def prefix(s: np.ndarray, percent: int) -> np.ndarray:
    """The least hashes of a set, of which any other set that is similar enough must share one (as it lacks too few to hold none)."""
    return s[: len(s) - -(-percent * len(s) // 100) + 1]


def _sign(width: int, percent: int, exact: bool):
    def run(batches):
        shingles = Shingles(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                sets = [shingles.of(t) for t in b.column(1).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                node, bands, sketch = ([None] * len(sets) for _ in range(3))
                if full:
                    x, y = signatures([sets[i] for i in full])
                    for j, i in enumerate(full):
                        node[i], bands[i], sketch[i] = _digest(sets[i]), prefix(sets[i], percent).view(np.int64) if exact else x[j], y[j].view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))], ["id", "n_shingles", "node", "bands", "sketch"])

    return run


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sets(width: int):
    """Sets of the texts wanted as some node, beside what they are wanted for; texts of another node that shares the id are left out."""

    def run(batches):
        shingles, last, node, found = Shingles(width), None, None, b""
        for b in batches:
            u, v, out = [], [], []
            for text, at, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
                # A text that several pairs want comes several times in a row.
                if text != last:
                    s = shingles.of(text)
                    last, node, found = text, _digest(s), s.tobytes()
                if node == wanted:
                    u.append(at)
                    v.append(wanted)
                    out.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary()), pa.array(out, pa.binary())], ["u", "v", "shingles"])

    return run


def _confirm(percent: int):
    """Keeps pairs with 100 * intersection >= percent * union, on whole sorted sets."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort()
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * same >= percent * (len(both) - same))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _grouped(batches, keys: list[str]):
    """Rows of sorted batches as one table for each run of equal keys."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        found = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        start = 0
        for at in range(len(found) + 1):
            now = found[at] if at < len(found) else None
            if at < len(found) and now == key:
                continue
            if at > start:
                held.append(batch.slice(start, at - start))
            if at < len(found):
                if held:
                    yield pa.Table.from_batches(held)
                held, start, key = [], at, now
    if held:
        yield pa.Table.from_batches(held)


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are paired with others, and all others; a group that is a whole bucket or family has no rows of side 0, as its small nodes are both."""
    side = group.column("side").to_numpy()
    left = np.flatnonzero(side == 0)
    return left if len(left) else np.flatnonzero(group.column("small").to_numpy(zero_copy_only=False)), np.flatnonzero(side == 1)


def _numbers(*columns) -> list[np.ndarray]:
    """Columns of nodes as numbers, equal ones alike; null is none of the nodes."""
    x = [np.array([v or b"" for v in c.to_pylist()], "S16") for c in columns]
    found = np.unique(np.concatenate(x), return_inverse=True)[1]
    return np.split(found, np.cumsum([len(c) for c in x])[:-1])


class _Forest:
    """Edges that keep together what pairs link: of pairs, no more than two for each of their first ends and node."""

    def __init__(self, n: int):
        self.tree, self.u, self.v, self.n = np.arange(n), [], [], []

    def add(self, x: int, hit: np.ndarray) -> None:
        """x is linked with every row of hit; the first edge bears how many they are."""
        if not len(hit):
            return
        trees, at = np.unique(self.tree[hit], return_index=True)
        new = trees != self.tree[x]
        to = hit[at[new]] if new.any() else hit[:1]
        if new.any():
            self.tree[np.isin(self.tree, trees[new])] = self.tree[x]
        self.u += [x] * len(to)
        self.v += to.tolist()
        self.n += [len(hit)] + [0] * (len(to) - 1)


def _cross(most: int, forest: bool):
    """Pairs of different components that share a bucket and pass the sketch; rows come sorted by bucket and blocks.

    Each pair has a node outside the bucket's largest component and any other; pairs tried before
    are left out. As a forest, rows are edges that hold the pairs' ends together, and n how many
    pairs an edge stands for: as many rows as nodes at most twice, however many pairs there are."""

    def run(batches):
        for group in _grouped(batches, ["bucket", "i", "j"]):
            left, right = _sides(group)
            if not len(left) or not len(right):
                continue
            node = group.column("node").combine_chunks()
            (label,), (name, tried) = _numbers(group.column("label")), _numbers(node, group.column("tried"))
            bits = group.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64)
            small, of = group.column("small").to_numpy(zero_copy_only=False), bits[right]
            found = _Forest(len(label))
            for x in left.tolist():
                ok = (np.bitwise_count(of ^ bits[x]).sum(axis=1) <= most) & (label[right] != label[x]) & (tried[right] != name[x]) & (name[right] != tried[x])
                if forest:
                    found.add(x, right[ok])
                    continue
                # Two small nodes meet in two groups, or twice in one; the lesser one keeps the pair.
                hit = right[ok & (~small[right] | (name[right] > name[x]))]
                found.u += [x] * len(hit)
                found.v += hit.tolist()
            if not found.u:
                continue
            ends = [node.take(pa.array(e, pa.int64())) for e in (found.u, found.v)]
            yield pa.RecordBatch.from_arrays(ends + [pa.array(found.n, pa.int64())] * forest, ["u", "v"] + ["n"] * forest)

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of left with every one of right.

    Hashes that many sets hold are counted by matrix products, a slice of them at a time, the others pair by pair."""
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left])
    total = np.zeros((len(left), len(right)), np.float32)
    hashes = [np.concatenate(side) for side in (left, right)]
    rows = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (left, right)]
    common = np.intersect1d(*hashes)
    if not len(common):
        return total.astype(np.int64)
    cols = []
    for k in (0, 1):
        at = np.minimum(np.searchsorted(common, hashes[k]), len(common) - 1)
        ok = common[at] == hashes[k]
        rows[k], at = rows[k][ok], at[ok]
        order = np.argsort(at, kind="stable")
        rows[k] = rows[k][order]
        cols.append(at[order])
    count = [np.bincount(c, minlength=len(common)) for c in cols]
    begin = [np.concatenate(([0], np.cumsum(n))) for n in count]
    many = count[0] * count[1] * RARE >= len(left) * len(right)
    often = np.flatnonzero(many)
    for at in range(0, len(often), SLICE):
        place = np.full(len(common), -1)
        place[often[at : at + SLICE]] = np.arange(len(often[at : at + SLICE]))
        x, y = (np.zeros((len(side), SLICE), np.float32) for side in (left, right))
        for m, r, c in zip((x, y), rows, cols, strict=True):
            ok = place[c] >= 0
            m[r[ok], place[c][ok]] = 1
        total += x @ y.T
    total = total.astype(np.int64)
    # The others: each row of left that has the hash with each row of right that has it.
    one = np.flatnonzero(~many[cols[0]])
    times = count[1][cols[0][one]]
    upto = np.concatenate(([0], np.cumsum(times)))
    start = 0
    while start < len(one):
        end = max(start + 1, int(np.searchsorted(upto, upto[start] + EXPANDED, "right")) - 1)
        n = times[start:end]
        x = np.repeat(rows[0][one[start:end]], n)
        y = np.arange(int(n.sum())) - np.repeat(upto[start:end] - upto[start], n) + np.repeat(begin[1][cols[0][one[start:end]]], n)
        total += np.bincount(x * len(right) + rows[1][y], minlength=total.size).reshape(total.shape)
        start = end
    return total


def _linked(percent: int):
    """A forest of the links, on whole sets, between different components of a family; rows come sorted by family and blocks."""

    def run(batches):
        for group in _grouped(batches, ["family", "i", "j"]):
            left, right = _sides(group)
            if not len(left) or not len(right):
                continue
            node, (label,) = group.column("node").combine_chunks(), _numbers(group.column("label"))
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for c in group.column("shingles").chunks for s in c]
            size = np.array([len(s) for s in sets])
            same = overlaps([sets[x] for x in left], [sets[y] for y in right])
            ok = (100 * same >= percent * (size[left][:, None] + size[right] - same)) & (label[left][:, None] != label[right])
            found = _Forest(len(label))
            for x, hit in zip(left.tolist(), ok, strict=True):
                found.add(x, right[hit])
            if found.u:
                yield pa.RecordBatch.from_arrays([node.take(pa.array(e, pa.int64())) for e in (found.u, found.v)], ["u", "v"])

    return run


def _hot(pairs: DataFrame, key: str) -> DataFrame:
    """Nodes of more than CHUNK pairs, and how many copies of their sets their pairs are spread over."""
    hot = pairs.groupBy(F.col(key).alias("hot")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK)
    return hot.select("hot", F.ceil(F.col("n") / CHUNK).cast("int").alias("parts"))


def _busier_first(pairs: DataFrame) -> DataFrame:
    """Pairs with the node of more pairs as u, as a v's set goes to each of its pairs."""
    n = pairs.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    d = pairs.join(n.toDF("u", "nu").hint("merge"), "u").join(n.toDF("v", "nv").hint("merge"), "v")
    swap = F.col("nv") > F.col("nu")
    return d.select(F.when(swap, F.col("v")).otherwise(F.col("u")).alias("u"), F.when(swap, F.col("u")).otherwise(F.col("v")).alias("v"))


def _with_sets(pairs: DataFrame, texts: DataFrame, low: DataFrame, width: int) -> DataFrame:
    """u, v and their sets su and sv of staged pairs; low has each node's least id, texts ids and texts.

    One scan makes each v's set once a pair and each u's set once, so a set meets its pairs in one
    shuffle; a u of many pairs has its set copied, so no group is large."""
    ends = pairs.select(F.lit(None).cast("binary").alias("at"), F.col("u").alias("node")).distinct().unionByName(pairs.select(F.col("u").alias("at"), F.col("v").alias("node")))
    sets = _made(ends, texts, low, width)
    hot = _hot(pairs, "u")
    parts = F.coalesce("parts", F.lit(1))
    left = sets.where(F.col("u").isNotNull()).join(hot, F.col("u") == F.col("hot"), "left").select("u", "v", F.col("shingles").alias("sv"), F.pmod(F.xxhash64("v"), parts).cast("int").alias("part"))
    right = sets.where(F.col("u").isNull()).join(hot, F.col("v") == F.col("hot"), "left").select(F.col("v").alias("node"), F.col("shingles").alias("su"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("on"))
    return left.join(right, (F.col("u") == F.col("node")) & (F.col("part") == F.col("on"))).select("u", "v", "su", "sv")


def _made(ends: DataFrame, texts: DataFrame, low: DataFrame, width: int) -> DataFrame:
    """u, v and shingles, staged, for ends of at and node: v's set for u. Wanted ids are broadcast up to MOST_WANTED rows; more meet the texts in a join."""
    wanted = stage(ends.join(low.hint("merge"), "node").select(F.col("low").alias("wanted"), "at", "node"), "wanted")
    small = wanted.count() <= MOST_WANTED
    named = wanted.where(F.col("wanted").isNotNull())
    found = texts.join(F.broadcast(named) if small else named, texts["id"] == named["wanted"]).select("text", "at", "node")
    bare = wanted.where(F.col("wanted").isNull())
    if not bare.isEmpty():
        # Nodes whose documents all have no id: their texts are told by the node itself.
        found = found.unionByName(_unnamed(texts.where(F.col("id").isNull()).select("text"), bare, width))
    sets = stage(found.mapInArrow(_sets(width), "u binary, v binary, shingles binary"), "sets")
    if sets.count() != sets.select("u", "v").distinct().count():
        sets = sets.dropDuplicates(["u", "v"])
    return sets


def _unnamed(texts: DataFrame, bare: DataFrame, width: int) -> DataFrame:
    """text, at and node of texts without id that are wanted: they are digested first, equal texts once."""

    def run(batches):
        shingles = Shingles(width)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_digest(shingles.of(t)) for t in b.column(0).to_pylist()], pa.binary())], ["text", "of"])

    known = texts.mapInArrow(run, "text string, of binary")
    return known.join(bare, F.col("of") == F.col("node")).select("text", "at", "node")


def _block(blocks: str):
    """A node's block among the given number of them."""
    return F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")


def _every(blocks: str):
    return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))


def _families(edges: DataFrame, nodes: DataFrame, label: DataFrame) -> DataFrame:
    """node, family, label, small (outside the family's largest component), blocks and small_blocks (of all and of small nodes), and dense, for each end of edges (u, v and the number n of pairs they stand for).

    A family is what edges reach. It is dense if it is one block, or if its small nodes times its
    nodes are at most DENSE times its pairs: then comparing all of them is cheaper than each pair."""
    of = components(edges.select("u", "v")).toDF("node", "family").join(nodes.select("node", "size").hint("merge"), "node").join(label.hint("merge"), "node", "left")
    of = stage(of.select("node", "family", F.coalesce("label", "node").alias("label"), (F.col("size") + LEAST).alias("weight")), "families")
    pairs = edges.join(of.select(F.col("node").alias("u"), "family").hint("merge"), "u").groupBy("family").agg(F.sum("n").alias("pairs"))
    total = of.groupBy("family", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("weight").alias("w")).groupBy("family").agg(F.max(F.struct("k", "label", "w")).alias("most"), F.sum("k").alias("k"), F.sum("w").alias("w"))
    blocks = lambda w: F.ceil(w / WEIGHT).cast("int")
    total = total.join(pairs.hint("merge"), "family").select("family", F.col("most.label").alias("big"), blocks(F.col("w")).alias("blocks"), blocks(F.col("w") - F.col("most.w")).alias("small_blocks"), ((F.col("k") - F.col("most.k")).cast("double") * F.col("k") <= DENSE * F.col("pairs")).alias("near"))
    total = total.withColumn("dense", F.col("near") | (F.col("blocks") == 1)).drop("near")
    return stage(of.drop("weight").join(total.hint("merge"), "family").withColumn("small", F.col("label") != F.col("big")).drop("big"), "families")


def _family_links(dense: DataFrame, texts: DataFrame, low: DataFrame, width: int, percent: int) -> DataFrame:
    """Links, on whole sets, that join the components of each dense family; a set is sent once a block it meets."""
    row = ["node", "family", "label", "small"]
    left = dense.where("small and blocks > 1").select(*row, _block("small_blocks").alias("i"), _every("blocks").alias("j"), F.lit(0).alias("side"))
    right = dense.select(*row, _every("small_blocks").alias("i"), _block("blocks").alias("j"), F.lit(1).alias("side"))
    placed = stage(left.unionByName(right), "placed")
    sets = _made(dense.select(F.lit(None).cast("binary").alias("at"), "node"), texts, low, width).select(F.col("v").alias("node"), "shingles")
    few = placed.count() <= MOST_WANTED
    met = sets.join(F.broadcast(placed) if few else placed.hint("merge"), "node").select("family", "i", "j", "side", "node", "label", "small", "shingles")
    return stage(met.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(_linked(percent), "u binary, v binary"), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, exact: bool = False) -> DataFrame:
    """id_col, n_shingles, component_id and kept, a row for each row of docs.

    Documents whose sets of width-word shingles have a similarity of percent or more are linked.
    Equal sets are one node from the start (so thousands of copies cost one comparison). Nodes that
    share one of 24 bands of 5 MinHash samples are candidates. First each bucket's least node is
    paired with the others, sifted by odd sketch; each node's best such pair is confirmed on full
    sets. Then, in buckets that still hold several components, all pairs across components are
    sifted by sketch, large buckets in pairs of blocks. Only the nodes outside a bucket's largest
    component are paired with the others. What these pairs reach is a family, kept as a forest, so
    that a thousand copies are no half million rows. The nodes outside a family's largest component
    are compared with all others on full sets, block by block, so a set is sent once a block and not
    once a pair; only families too sparse for that have their pairs listed and confirmed one by one.
    No bucket, pair, family or partner is capped.

    Two steps may lose a link, each by chance and measured in the tests: a pair of similarity 0.8
    shares no band with probability 7e-5, and an estimate by sketch falls under SIFT with about 3e-5.
    exact=True loses none: candidates are all pairs that share a hash of their sets' prefixes, and
    none is sifted; its buckets are a fifth of all shingles, so it costs many times more.

    Null or wordless texts have an empty set and link with nothing. Repeated rows and equal texts
    share a component; its id is the least non-null id, and rows of that id are kept (a null id
    gets a null component if all its copies' ids are null, and is kept if it has no set). Long
    texts count whole. Other columns are ignored; an empty table gives no rows."""
    most = BITS if exact else MOST_BITS
    sig = stage(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(_sign(width, percent, exact), f"id {docs.schema[id_col].dataType.simpleString()}, n_shingles long, node binary, bands array<bigint>, sketch array<bigint>"), "signed")
    nodes = stage(sig.where("node is not null").groupBy("node").agg(F.min("id").alias("low"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes")
    members = nodes.select(F.explode("bands").alias("bucket"), "node")
    buckets = members.groupBy("bucket").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = stage(members.join(buckets.hint("merge"), "bucket"), "members")

    best = members.where("node != leader").select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct()
    # The joins are the same at every size: these tables grow with the documents, so none is broadcast.
    sketch = nodes.select("node", "sketch").hint("merge")
    best = best.join(sketch.toDF("u", "su").hint("merge"), "u").join(sketch.toDF("v", "sv").hint("merge"), "v").withColumn("odd", _odd("su", "sv")).where(F.col("odd") <= most)
    best = stage(best.groupBy("v").agg(F.min(F.struct("odd", "u")).alias("x")).select("x.u", "v"), "stars")

    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())

    def confirm(pairs: DataFrame) -> DataFrame:
        return stage(_with_sets(pairs, texts, nodes.select("node", "low"), width).mapInArrow(_confirm(percent), "u binary, v binary"), "links")

    links = confirm(best)
    label = components(links)
    held = members.join(label.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    size = held.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("bucket").agg(F.max(F.struct("k", "label")).alias("most"), F.sum("k").alias("n_all"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    size = size.where("most.k < n_all").select("bucket", F.col("most.label").alias("big"), blocks(F.col("n_all")).alias("blocks"), blocks(F.col("n_all") - F.col("most.k")).alias("small_blocks"))
    held = held.select("bucket", "node", "label").join(size.hint("merge"), "bucket").join(sketch, "node").withColumn("small", F.col("label") != F.col("big"))
    held = held.join(best.select(F.col("v").alias("node"), F.col("u").alias("tried")).hint("merge"), "node", "left")
    held = stage(held.drop("big"), "held")

    def cross(held: DataFrame, forest: bool) -> DataFrame:
        row = ["node", "label", "sketch", "small", "tried"]
        left = held.where("small and blocks > 1").select("bucket", _block("small_blocks").alias("i"), _every("blocks").alias("j"), F.lit(0).alias("side"), *row)
        right = held.select("bucket", _every("small_blocks").alias("i"), _block("blocks").alias("j"), F.lit(1).alias("side"), *row)
        return left.unionByName(right).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node").mapInArrow(_cross(most, forest), "u binary, v binary" + ", n long" * forest)

    edges = stage(cross(held, True), "edges")
    if not edges.isEmpty():
        family = _families(edges, nodes, label)
        more = _family_links(family.where("dense"), texts, nodes.select("node", "low"), width, percent)
        sparse = family.where("not dense").select("node")
        if not sparse.isEmpty():
            pairs = cross(held.join(sparse.hint("merge"), "node", "left_semi"), False)
            pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
            more = more.unionByName(confirm(stage(_busier_first(stage(pairs, "pairs")), "pairs")))
        if not more.isEmpty():
            label = components(links.unionByName(more))

    of = nodes.select("node", "low").join(label.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = of.groupBy("label").agg(F.min("low").alias("component"))
    of = stage(of.join(least.hint("merge"), "label").select("node", "component"), "components")
    out = sig.select("id", "n_shingles", "node").join(of.hint("merge"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id")).withColumn("kept", F.when(F.col("n_shingles") == 0, True).otherwise(F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False))))


def _odd(a: str, b: str):
    """Differing bits of two sketches."""
    total = F.lit(0)
    for k in range(BITS // 64):
        total = total + F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k))))
    return total


def op1(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document: two-word shingles, 80 per cent."""
    return near_duplicates(docs.select("doc_id", "text"), width=2)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of each near-duplicate group, the one of least id; no text is lost.

    Wordless rows and rows of null id all stay, as no id names them. Of rows repeating an id and
    its text one stays; rows that share an id but not the text stay together."""
    row, text_hash = fresh(docs, "row", "text_hash")
    found = near_duplicates(docs, id_col, text, **options).where("kept")
    once = found.where("n_shingles > 0").select(F.col(id_col).alias(row)).where(F.col(row).isNotNull()).distinct()
    grouped = F.coalesce(docs[text].rlike(r"[^\x20\x09-\x0D]"), F.lit(False)) & docs[id_col].isNotNull()
    first = docs.where(grouped).join(once, docs[id_col] == once[row], "left_semi")
    first = first.withColumn(text_hash, F.xxhash64(text)).dropDuplicates([id_col, text_hash]).drop(text_hash)
    return first.unionByName(docs.where(~grouped))


def query(spark, sf_dir: str) -> DataFrame:
    return op1(table(spark, sf_dir, "documents"))
