"""Similarity join on word shingles with signature trees.

1. A sketch of fixed size counts the shingles of all texts, which orders shingles from
   rare to common (ties by hash). Any order is exact; this one keeps common passages out of prefixes.
   Equal sets go on as one.
2. Let a prefix be the first 0.3 n (and one more) of a set's n shingles in that order. Linked
   sets of m and n shingles have at least 0.1 min(m, n) shingles of both prefixes in common, as no
   more than 0.2 n of a set may be missing in the other. Each task groups the postings of its
   shingles and sees which are shared with a text of a size that allows a link. Texts with too few
   of these are linked with none and leave. Of those that stay, the first 0.2 n (and one more)
   shingles have one in common for every link. Along each shingle's texts, by size, neighbours are
   joined, first for a sample of the shingles; the components of these edges hold every link.
3. Sets of such a component meet in one task. Large components are cut into classes of size, each
   as wide as half of the range that a link allows, and these into blocks; blocks of classes that
   a link can span meet in pairs. There a signature tree is built: its leaves are the sets, a node holds
   the OR of its leaves' token bitmaps, their size range and how many tokens share bits.
   The dual traversal drops a pair of nodes when sizes, or the overlap that bitmaps allow,
   rule out a link, or when both are already in one component; what remains is verified
   on the full sets.
4. Components of the verified links are the result.

Words and shingles are compared by hashes of 64 bits, equal sets by 128 bits and their size: results
are exact but for collisions of these.

Defined results: A-Z in lower case; a text with fewer than 5 words has its whole sequence as
its one shingle; without words or text the set is empty and linked with nothing; rows that
repeat an id are one document with the union of their links; each text with a null id is a
document of its own, whose component has the least id that isn't null, or null if there is none
(other ids must be below 2 ** 62); texts are read whole; an empty table gives no rows. Other columns
are ignored, and kept by representatives().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, marked, partitions, release, remove, spread, stored, tidy, unused
from .components import components, local_forest
from .words import LOWER, bytes_of, grams, hash_words, mix64, slices, split_words, whole

WORDS = 5
NUM, DEN = 80, 100
SKETCH_BITS = 20
CHUNKS = 16
#: Tokens of the sets that one task compares with each other.
BLOCK_TOKENS = 3_000_000
#: Bytes of postings that one task sorts.
BUCKET = 16 << 20
#: Where the ids that stand for null begin.
STAND_IN = 1 << 62
#: One of so many shingles joins texts before all do.
SAMPLE = 16


def shingle_sets(buf: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    buf = LOWER[buf]
    begins, ends, first = split_words(buf, offs)
    h = hash_words(buf, begins, ends)
    g = grams(h, WORDS)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WORDS:
            yield np.unique(g[a : b - WORDS + 1])
        else:
            yield np.array([whole(h[a:b])] if b > a else [], np.uint64)


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    buf, offs = bytes_of(batch.column("text"))
    ids = batch.column("doc_id").to_pylist()
    for i, _, part, o in slices(buf, offs):
        for k, s in enumerate(shingle_sets(part, o)):
            yield ids[i + k], s


def prefix_length(n):
    """At least n - ceil(0.8 n) + 0.1 n; for numbers and arrays."""
    return (3 * n) // 10 + (n > 0)


def least_shared(n):
    """A linked set of n shingles shares at least so many of its prefix: a tenth of the smallest partner's size."""
    smallest = (NUM * n + DEN - 1) // DEN
    return np.maximum(1, (smallest + 9) // 10)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def sketch(docs: DataFrame) -> np.ndarray:
    """Counts of all texts' shingles by the first SKETCH_BITS bits of their hash."""
    width = (1 << SKETCH_BITS) // CHUNKS
    schema = pa.schema([("chunk", pa.int32()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(1 << SKETCH_BITS, np.int64), [], 0

        def add():
            if held:
                total[:] += np.bincount((np.concatenate(held) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
                held.clear()

        for b in batches:
            for _, s in _sets(b):
                held.append(s)
                n += len(s)
                if n > 2_000_000:
                    add()
                    n = 0
        add()
        if total.any():
            yield _batch([(c, total[c * width : (c + 1) * width].astype(np.uint32).tobytes()) for c in range(CHUNKS)], schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, x in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist()):
                sums[c] = sums.get(c, 0) + np.frombuffer(x, np.uint32).astype(np.int64)
        for c, x in sums.items():
            yield _batch([(c, np.minimum(x, 0xFFFFFFFF).astype(np.uint32).tobytes())], schema)

    kind = "chunk int, counts binary"
    rows = docs.mapInArrow(tidy(count), kind).repartition(CHUNKS, "chunk").mapInArrow(tidy(merge), kind).collect()  # 4 << SKETCH_BITS bytes
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    for r in rows:
        out[r["chunk"] * width : (r["chunk"] + 1) * width] = np.frombuffer(r["counts"], np.uint32)
    return out


def _features(docs: DataFrame, counts) -> DataFrame:
    """doc_id, n, d1, d2 (digest of the set), prefix."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("prefix", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = counts.value
        for b in batches:
            rows = []
            for i, s in _sets(b):
                if len(s) == 0:
                    rows.append((i, 0, 0, 0, b""))
                    continue
                p = prefix_length(len(s))
                rank = order[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                cut = np.partition(rank, p - 1)[p - 1]
                near = np.flatnonzero(rank <= cut)  # sets are sorted by hash, so a stable sort breaks ties by it
                first = s[near[np.argsort(rank[near], kind="stable")[:p]]]
                d = np.array([s.sum(dtype=np.uint64), mix64(s).sum(dtype=np.uint64)], np.uint64).view(np.int64)
                rows.append((i, len(s), int(d[0]), int(d[1]), first.tobytes()))
                if len(rows) >= 2000:
                    yield _batch(rows, schema)
                    rows = []
            yield _batch(rows, schema)

    return docs.mapInArrow(tidy(run), "doc_id long, n long, d1 long, d2 long, prefix binary")


_POSTING = np.dtype([("t", np.uint64), ("n", np.int32), ("i", np.int64)])
_TALLY = np.dtype([("n", np.int32), ("c", np.int32), ("i", np.int64)])
_BLOBS = pa.schema([("bucket", pa.int32()), ("records", pa.binary())])
_BLOB_KIND = "bucket int, records binary"


def _dealt(bucket: np.ndarray, keys: list[int], records: np.ndarray) -> pa.RecordBatch:
    """Records by bucket; keys: what stands for each bucket."""
    buckets = len(keys)
    records, cut = records[np.argsort(bucket, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
    return _batch([(keys[k], records[cut[k] : cut[k + 1]].tobytes()) for k in range(buckets) if cut[k + 1] > cut[k]], _BLOBS)


def _read(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join([x for b in batches for x in b.column("records").to_pylist()]), kind)


def _neighbours(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Postings by shingle and size, without those whose shingle is in one text; whether each may link with the one before."""
    order = np.argsort(p["t"], kind="stable")
    t = p["t"][order]
    shared = np.zeros(len(t), bool)
    shared[1:] = t[1:] == t[:-1]
    shared[:-1] |= shared[1:]
    p = p[order[shared]]
    p = p[np.lexsort((p["i"], p["n"], p["t"]))]
    close = np.zeros(len(p), bool)
    close[1:] = (p["t"][1:] == p["t"][:-1]) & (DEN * p["n"][:-1].astype(np.int64) >= NUM * p["n"][1:].astype(np.int64)) & (p["i"][1:] != p["i"][:-1])
    return p, close


def filter_bits(n: int) -> int:
    """Bits of a filter over n ids, as a power of two: 16 a document, from 8 KB to 32 MB."""
    return min(28, max(16, math.ceil(math.log2(16 * n + 1))))


def bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    """A filter of ids of a bounded size: bit xxhash64(id) mod 2 ** bits. Where it fills up, more ids pass and the result is the same."""
    rows = ids.select((_place("doc_id", bits) + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)  # the bitmap functions count from 1
    for r in rows:
        at = (r["k"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _place(column: str, bits: int):
    return F.pmod(F.xxhash64(column), F.lit(1 << bits))


def _filtered(batch: pa.RecordBatch, bits: np.ndarray) -> pa.RecordBatch:
    p = batch.column("_place").to_numpy()
    return batch.filter(pa.array((bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1))


def _postings(features: DataFrame, buckets: int, kept=None) -> DataFrame:
    """Shingles (t, n, i) of the prefixes, dealt out; kept: from a batch's rows, the leading number of each and a mask of shingles."""

    keys = spread(buckets)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for k in range(0, whole_batch.num_rows, 2000):
                b = whole_batch.slice(k, 2000)
                n = b.column("n").to_numpy()
                token = np.frombuffer(b"".join(b.column("prefix").to_pylist()), np.uint64)
                size = prefix_length(n)
                rows = np.empty(len(token), _POSTING)
                rows["t"], rows["n"], rows["i"] = token, np.repeat(n, size), np.repeat(b.column("i").to_numpy(), size)
                if kept is not None:
                    rows = rows[kept(n, size, token)]
                yield _dealt((mix64(rows["t"]) % np.uint64(buckets)).astype(np.int64), keys, rows)

    return features.select("i", "n", "prefix").mapInArrow(tidy(post), _BLOB_KIND).repartition(buckets, "bucket")


def _leading(n: np.ndarray, size: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The first n // 5 + 1 shingles of each prefix: linked sets have one of these in common, as before
    their first common shingle a set has only missing ones, 0.2 n at most."""
    place = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
    return place <= np.repeat(n // 5, size)


def _sampled(n: np.ndarray, size: np.ndarray, token: np.ndarray) -> np.ndarray:
    """One of SAMPLE shingles, the same ones in all texts."""
    return _leading(n, size, token) & ((mix64(token) >> np.uint64(32)) % np.uint64(SAMPLE) == 0)


def _possible(features: DataFrame, buckets: int) -> DataFrame:
    """doc_id of the texts that share enough of their prefix."""

    keys = spread(buckets)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, close = _neighbours(_read(batches, _POSTING))
        if len(p):
            close[:-1] |= close[1:]
            i, at, c = np.unique(p["i"][close], return_index=True, return_counts=True)
            rows = np.empty(len(i), _TALLY)
            rows["n"], rows["c"], rows["i"] = p["n"][close][at], c, i
            yield _dealt((mix64(i.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), keys, rows)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _read(batches, _TALLY)
        i, first, at = np.unique(r["i"], return_index=True, return_inverse=True)
        c = np.bincount(at, r["c"], minlength=len(i))
        yield pa.RecordBatch.from_arrays([pa.array(i[c >= least_shared(r["n"][first].astype(np.int64))])], ["doc_id"])

    return _postings(features.withColumnRenamed("doc_id", "i"), buckets).mapInArrow(tidy(tally), _BLOB_KIND).repartition(buckets, "bucket").mapInArrow(tidy(total), "doc_id long")


def _candidates(features: DataFrame, buckets: int) -> DataFrame:
    """node, root: components of the texts that may link.

    Each task makes a forest of what its shingles join. A text would be in the forests of as many
    tasks as it has shingles; so a sample of the shingles first hands each text the least text that
    any of its tasks joins it to, and all leading shingles then join only these."""
    possible = checkpointed(_possible(features, buckets))
    left = marked(features, possible, "doc_id", filter_bits(features.count())).filter("maybe")
    release(features.sparkSession)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, close = _neighbours(_read(batches, _POSTING))
        at = np.flatnonzero(close)
        if len(at):
            edges = np.unique(np.stack([p["i"][at], p["i"][at - 1]], 1), axis=0)
            node, root = local_forest(edges[:, 0], edges[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["a", "b"])

    first = checkpointed(_postings(left.withColumnRenamed("doc_id", "i"), buckets, _sampled).mapInArrow(tidy(chain), "a long, b long").groupBy("a").agg(F.min("b").alias("b")))
    joined = left.join(first, F.col("doc_id") == F.col("a"), "left").select(F.coalesce("b", "doc_id").alias("i"), "n", "prefix")
    return components(_postings(joined, buckets, _leading).mapInArrow(tidy(chain), "a long, b long").union(first))


class SignatureTree:
    """Sets by size in groups of FAN, level over level. Level 0 are the sets themselves."""

    FAN = 8

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets])
        bits = max(256, 1 << int(math.ceil(math.log2(4 * max(1, int(np.median(sizes)))))))
        bits = min(bits, 1 << 16, max(256, 1 << int(math.log2(max(256, (64 << 23) // len(sets))))))  # 64 MB for all leaves
        sig = np.zeros((len(sets), bits // 8), np.uint8)
        excess = np.empty(len(sets), np.int64)
        for k, s in enumerate(sets):
            at = np.unique((s & np.uint64(bits - 1)).astype(np.int64))
            np.bitwise_or.at(sig[k], at >> 3, (1 << (at & 7)).astype(np.uint8))
            excess[k] = len(s) - len(at)
        self.levels = [(sig.view(np.uint64), sizes, sizes, excess)]
        while len(self.levels[-1][1]) > 1:
            sig, low, high, excess = self.levels[-1]
            cut = np.arange(0, len(low), self.FAN)
            self.levels.append((np.bitwise_or.reduceat(sig, cut, 0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(excess, cut)))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sets below the nodes a and b may link, by size range and maximum possible overlap."""
        sig, low, high, excess = self.levels[level]
        ok = (DEN * high[a] >= NUM * low[b]) & (DEN * high[b] >= NUM * low[a])
        at = np.flatnonzero(ok)
        x, y = a[at], b[at]
        common = np.bitwise_count(sig[x] & sig[y]).sum(1, dtype=np.int64)
        most = np.minimum(common + np.minimum(excess[x], excess[y]), np.minimum(high[x], high[y]))
        # i / (na + nb - i) >= NUM / DEN  <=>  i * (DEN + NUM) >= NUM * (na + nb)
        ok[at] = most * (DEN + NUM) >= NUM * (low[x] + low[y])
        return ok

    def children(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.levels[level - 1][1])
        f = np.arange(self.FAN)
        x = np.repeat(a[:, None] * self.FAN + f, self.FAN, 1).ravel()
        y = np.tile(b[:, None] * self.FAN + f, (1, self.FAN)).ravel()
        ok = (x < n) & (y < n) & (x <= y)
        return x[ok], y[ok]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common * (DEN + NUM) >= NUM * (len(a) + len(b))


#: Pairs of nodes that a traversal looks at together.
AT_ONCE = 8192


def link_forest(ids: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join all linked ids: a forest with the components of the exact similarity graph."""
    order = np.lexsort((ids, [int(s[0]) if len(s) else 0 for s in sets], [len(s) for s in sets]))
    ids, sets = ids[order], [sets[k] for k in order]
    parent = np.arange(len(ids))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found: list[tuple[int, int]] = []

    def verify(x: int, y: int) -> None:
        p, q = find(x), find(y)
        if p != q and linked(sets[x], sets[y]):
            parent[max(p, q)] = min(p, q)
            found.append((int(ids[x]), int(ids[y])))

    tree = SignatureTree(sets)
    top = len(tree.levels) - 1
    stack = [(top, np.array([0]), np.array([0]))]
    while stack:
        level, a, b = stack.pop()
        if len(a) > AT_ONCE:
            stack.append((level, a[AT_ONCE:], b[AT_ONCE:]))
            a, b = a[:AT_ONCE], b[:AT_ONCE]
        while not np.array_equal(parent, parent[parent]):
            parent[:] = parent[parent]
        low, high = parent, parent
        for _ in range(level):
            cut = np.arange(0, len(low), tree.FAN)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
        apart = (low[a] != high[a]) | (low[b] != high[b]) | (low[a] != low[b])  # not all in one component
        a, b = a[apart], b[apart]
        ok = tree.possible(level, a, b)
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        if level:
            stack.append((level - 1, *tree.children(level, a, b)))
        else:
            for x, y in zip(a.tolist(), b.tolist()):
                if x != y:
                    verify(x, y)
    return found


def _verified(members: DataFrame) -> DataFrame:
    """Edges of the exact links from (block, doc_id, tokens), a block's rows together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, sets, out = None, [], [], []
        for b in batches:
            for block, i, s in zip(b.column("block").to_pylist(), b.column("doc_id").to_pylist(), b.column("tokens").to_pylist()):
                if block != at:
                    if len(ids) > 1:
                        out += link_forest(np.array(ids), sets)
                    at, ids, sets = block, [], []
                ids.append(i)
                sets.append(np.frombuffer(s, np.uint64))
        if len(ids) > 1:
            out += link_forest(np.array(ids), sets)
        yield _batch(out, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    spark = members.sparkSession
    return members.repartition(partitions(spark), "block").sortWithinPartitions("block", "doc_id").mapInArrow(tidy(run), "a long, b long")


def _chosen(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """doc_id, tokens and the columns of wanted for the wanted of n documents. A filter of ids keeps most others from being sent."""
    bits = filter_bits(n)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, bits))
    schema = pa.schema([("doc_id", pa.int64()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = _filtered(b, shared.value)
            for i in range(0, b.num_rows, 500):
                yield _batch([(d, s.tobytes()) for d, s in _sets(b.slice(i, 500))], schema)

    sets = docs.select("doc_id", "text", _place("doc_id", bits).alias("_place")).mapInArrow(tidy(run), "doc_id long, tokens binary")
    return sets.join(wanted, "doc_id")


def size_class(n):
    """Two classes cover the range of sizes that may link, so links span classes that differ by 2 at most."""
    return F.floor(F.log(n.cast("double")) / math.log((DEN / NUM) ** 0.5) + 1e-9).cast("int")


def blocks(sets: DataFrame) -> DataFrame:
    """From (doc_id, root, n): doc_id, block for every unit of work that a set takes part in. Sets that may link share a unit."""
    sets = sets.withColumn("class", size_class(F.col("n")))
    totals = sets.groupBy("root", "class").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("sets"))
    whole = totals.groupBy("root").agg(F.sum("tokens").alias("all"), F.sum("sets").alias("members")).filter("members > 1")
    sets = sets.join(whole, "root")
    one = sets.filter(F.col("all") <= BLOCK_TOKENS).select("doc_id", F.col("root").cast("string").alias("block"))
    parts = totals.join(whole.filter(F.col("all") > BLOCK_TOKENS), "root").select("root", F.col("class").alias("_with"), F.ceil(F.col("tokens") / BLOCK_TOKENS).cast("int").alias("parts"))
    large = sets.filter(F.col("all") > BLOCK_TOKENS).select("doc_id", "root", "class")
    large = large.join(parts.select("root", F.col("_with").alias("class"), F.col("parts").alias("mine")), ["root", "class"]).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("mine")).cast("int"))
    large = large.withColumn("_with", F.explode(F.sequence(F.col("class") - 2, F.col("class") + 2))).join(parts, ["root", "_with"])
    large = large.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    a, b = F.struct(F.col("class").alias("c"), F.col("own").alias("p")), F.struct(F.col("_with").alias("c"), F.col("_other").alias("p"))
    low, high = F.least(a, b), F.greatest(a, b)
    return one.union(large.select("doc_id", F.concat_ws("/", "root", low["c"], low["p"], high["c"], high["p"]).alias("block")).distinct())


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text, with ids of their own for texts whose id is null."""
    own = F.lit(STAND_IN) + F.pmod(F.xxhash64("text"), F.lit(STAND_IN - 1))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), own).alias("doc_id"), "text")


def jaccard_components(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    found = _components(spark, _identified(docs))
    shown = lambda c: F.when(F.col(c) < STAND_IN, F.col(c)).alias(c)
    return found.select(shown("doc_id"), "n_shingles", shown("component_id"))


def _components(spark: SparkSession, docs: DataFrame) -> DataFrame:
    counts = spark.sparkContext.broadcast(sketch(docs))
    features, first_at = stored(_features(docs, counts))
    release(spark)
    size = features.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("rows")).first()
    # of equal sets the one with the least id goes on
    same = features.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).filter("rep < last").select("n", "d1", "d2", "rep")
    doubled = checkpointed(features.select("doc_id", "n", "d1", "d2").join(same, ["n", "d1", "d2"]).filter("doc_id <> rep"))
    copies = doubled.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    flagged = marked(features.filter("n > 0"), doubled, "doc_id", filter_bits(size["rows"]))
    single = flagged.filter("maybe").join(doubled.select("doc_id", "n", "d1", "d2"), ["doc_id", "n", "d1", "d2"], "left_anti")
    own, at = stored(flagged.filter("not maybe").select("doc_id", "n", "prefix").union(single.select("doc_id", "n", "prefix")))
    n_shingles = checkpointed(features.groupBy("doc_id").agg(F.max("n").alias("n_shingles")))
    remove(spark, first_at)
    release(spark)
    buckets = max(partitions(spark), -(-(size["tokens"] or 0) * 3 // 10 * _POSTING.itemsize // BUCKET))
    candidates = _candidates(own, buckets)
    release(spark)
    sizes = own.groupBy("doc_id").agg(F.max("n").alias("n"))  # rows of one id with different texts are one node
    members = candidates.select(F.col("node").alias("doc_id"), "root").join(sizes, "doc_id")
    units = checkpointed(blocks(members))
    remove(spark, at)
    release(spark)
    links = _verified(_chosen(docs, units, size["rows"]).select("block", "doc_id", "tokens"))
    found = components(checkpointed(links.union(copies)))
    release(spark)
    out = n_shingles.join(found.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def representatives(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs whose document has the smallest id of its component; ids come before null."""
    names = unused(docs.columns, "_own", "_kept")
    own = docs.withColumn(names[0], F.coalesce(F.col("doc_id").cast("long"), F.lit(STAND_IN) + F.pmod(F.xxhash64("text"), F.lit(STAND_IN - 1))))
    kept = _components(spark, _identified(docs)).filter("doc_id = component_id").select(F.col("doc_id").alias(names[1]))
    return own.join(kept, own[names[0]] == F.col(names[1]), "left_semi").select(*docs.columns)
