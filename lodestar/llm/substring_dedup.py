"""Substring deduplication with suffix automata over shards of shared text.

A window is SPAN consecutive words. Its key is the least hash of its (SPAN - PICK + 1)-word
grams, so equal windows have equal keys, and a document falls into segments: runs of
windows with one key, SPAN - 1 words longer than their windows are many. Keys of very many
different segments (see HOT) are replaced by the hashes of their whole windows.

1. All keys are dealt out by hash with their segment's digest and the least and greatest document
   that a task found it in. That gives a bitmap of the keys that are found in several documents.
2. Of the segments with such a key each task sends the words of every different one once, with the
   least and greatest document. A key's segments are a reference shard: a suffix automaton is built
   over them, each state with the least document that holds it, and the segments stream through it for
   matching statistics: a match of SPAN words or more, shortened to SPAN, gives the least document
   with that window. What a segment's windows have as least documents is its rule.
3. Every occurrence of a segment with a rule learns by it which of its windows a smaller document holds:
   those of the most frequent rules, at most FREQUENT, where the text is read, the others
   where their rule is dealt to.
4. The covered windows of each document are merged into maximal spans and cut from its words.

The reference set grows with the corpus, so the automata are not broadcast whole: each goes
only to the task that has the segments which can match in it. What is broadcast are two
bitmaps of 32 MB at most, the replaced keys and the frequent rules. Where the bitmaps fill up, more
segments take part, and the result is the same. The number of buckets grows with the text.

Words and windows are compared by hashes of 64 bits: results are exact but for collisions of these.

Defined results: null text has no words; texts with fewer than SPAN words keep all; a document
with a null id keeps all and is no reference; rows with one id are one document in the
comparison, so they don't remove each other's words; an empty table gives no rows.
Texts are read whole. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, marked, partitions, release, settings, spread, tidy
from .words import bytes_of, grams, hash_words, mix64, powers, slices, split_words

SPAN = 13
#: Grams in a window, of which the least is its key.
PICK = 9
#: Bytes of text for each bucket of segments.
BUCKET = 32 << 20
#: A key with more different segments than this, and than a 2 ** 20th of all, is replaced; so fewer than 2 ** 20 are.
HOT = 10_000
#: Rules that every task gets, those of the most occurrences; of FREQUENT_WINDOWS windows at most each.
FREQUENT, FREQUENT_WINDOWS = 1000, 64
#: Shuffle files go when the job that wrote them ends, not when the driver's garbage happens to be collected: one step's at a time.
CLEAN = "spark__sql__classic__shuffleDependency__fileCleanup__enabled"
#: Records that a task holds to combine them.
HELD = 1 << 19

_KEY = np.dtype([("m", np.uint64), ("seg", np.uint64), ("low", np.int64), ("high", np.int64)])
_SHARED = np.dtype([("m", np.uint64), ("seg", np.uint64), ("low", np.int64), ("high", np.int64), ("count", np.int64), ("n", np.int32)])
_SEEN = np.dtype([("m", np.uint64), ("seg", np.uint64), ("doc", np.int64), ("row", np.int64), ("at", np.int32), ("n", np.int32)])
_COVER = np.dtype([("doc", np.int64), ("row", np.int64), ("at", np.int32), ("n", np.int32)])
_BLOBS = pa.schema([("bucket", pa.int32()), ("records", pa.binary()), ("words", pa.binary())])
_KIND = "bucket int, records binary, words binary"


def segments(h: np.ndarray, first: np.ndarray, replaced: np.ndarray = np.zeros(0, np.uint64)) -> tuple[np.ndarray, ...]:
    """Of the texts whose words' hashes are h[first[d]:first[d + 1]]: key, digest, text, first word in h, windows, whether the
    key stands for a replaced one. replaced: sorted keys."""
    count = np.maximum(np.diff(first) - SPAN + 1, 0)
    none = np.zeros(0, np.int64)
    if not count.sum():
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none.astype(bool)
    g = grams(h, SPAN - PICK + 1)
    least = g[: len(g) - PICK + 1].copy()
    for j in range(1, PICK):
        np.minimum(least, g[j : j + len(least)], out=least)
    least = mix64(least)  # least hashes are small ones: mixed, they fill all buckets alike
    hot = np.zeros(len(least), bool)
    if len(replaced):
        hot = replaced[np.minimum(np.searchsorted(replaced, least), len(replaced) - 1)] == least
        least[hot] = grams(h, SPAN)[hot]
    text = np.repeat(np.arange(len(count)), count)
    window = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[:-1], count)
    m = least[window]
    new = np.ones(len(m), bool)
    new[1:] = (m[1:] != m[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(m)))
    at = window[begin]
    p, q = powers(len(h) + 1)
    c = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p[: len(h)], out=c[1:])
    digest = mix64((c[at + n + SPAN - 1] - c[at]) * q[at] + n.astype(np.uint64))
    return m[begin], digest, text[begin], at, n, hot[at]


def _segments(batch: pa.RecordBatch, replaced: np.ndarray = np.zeros(0, np.uint64)) -> Iterator[tuple]:
    """By slice: key, digest, row of the batch, first word in its text, windows, whether the key is new; word hashes, first word in these."""
    buf, offs = bytes_of(batch.column("text"))
    for i, _, part, o in slices(buf, offs):
        begins, ends, first = split_words(part, o)
        h = hash_words(part, begins, ends)
        m, seg, text, at, n, new = segments(h, first, replaced)
        yield m, seg, text + i, at - first[:-1][text], n, new, h, at


def _dealt(bucket: np.ndarray, keys: list[int], records: np.ndarray, lengths: np.ndarray | None = None, words: np.ndarray | None = None) -> pa.RecordBatch:
    """Records by bucket, with their words if they have some; keys: what stands for each bucket; lengths: words of each record."""
    buckets = len(keys)
    order = np.argsort(bucket, kind="stable")
    cut = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
    records, rows = records[order], []
    if words is not None:
        words = _taken(words, (np.cumsum(lengths) - lengths)[order], lengths[order])
        word_cut = np.concatenate([[0], np.cumsum(lengths[order])])[cut]
    for k in np.flatnonzero(np.diff(cut)).tolist():
        rows.append((keys[k], records[cut[k] : cut[k + 1]].tobytes(), b"" if words is None else words[word_cut[k] : word_cut[k + 1]].tobytes()))
    columns = list(zip(*rows)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOBS)], schema=_BLOBS)


def _taken(values: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs values[begin:begin + lengths], one after the other."""
    return values[np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]


def _place(m: np.ndarray, bits: int) -> np.ndarray:
    return (m >> np.uint64(64 - bits)).astype(np.int64)


def _among(m: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    p = _place(m, bits)
    return bitmap[p >> 3] >> (p & 7).astype(np.uint8) & 1 == 1


def _pairs(m: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """One hash for key and segment."""
    return mix64(m ^ (seg * np.uint64(0x9E3779B97F4A7C15)))


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Whether each row of sorted columns differs from the one before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _combined(r: np.ndarray) -> np.ndarray:
    """_KEY records with one for each key and segment."""
    r = r[np.lexsort((r["seg"], r["m"]))]
    cut = np.flatnonzero(_heads(r["m"], r["seg"]))
    out = r[cut]
    if len(cut):
        out["low"], out["high"] = np.minimum.reduceat(r["low"], cut), np.maximum.reduceat(r["high"], cut)
    return out


def _read(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    records, words = [], []
    for b in batches:
        records += b.column("records").to_pylist()
        words += b.column("words").to_pylist()
    return np.frombuffer(b"".join(records), kind), np.frombuffer(b"".join(words), np.uint64)


def _parts(place: np.ndarray, chosen: np.ndarray, buckets: int, bits: int) -> Iterator[tuple[int, bytes]]:
    """Stretches of the bitmap: a bucket has a run of places, so each part of it is sent once."""
    bucket = place * buckets >> bits
    for k in np.unique(bucket).tolist():
        mine = bucket == k
        low, high = int(place[mine].min()) >> 3, (int(place[mine].max()) >> 3) + 1
        flags = np.zeros((high - low) << 3, np.uint8)
        flags[place[mine & chosen] - (low << 3)] = 1
        yield low, np.packbits(flags, bitorder="little").tobytes()


def shared_keys(docs: DataFrame, buckets: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A bitmap of 2 ** bits over the keys' first bits: found in several documents; and the sorted keys of very many segments."""
    keys = spread(buckets)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for m, seg, row, *_ in _segments(b):
                r = np.empty(len(m), _KEY)
                r["m"], r["seg"], r["low"], r["high"] = m, seg, ids[row], ids[row]
                held.append(r)
                n += len(r)
                if n > HELD:
                    r, held, n = _combined(np.concatenate(held)), [], 0
                    yield _dealt(_place(r["m"], bits) * buckets >> bits, keys, r)
        if held:
            r = _combined(np.concatenate(held))
            yield _dealt(_place(r["m"], bits) * buckets >> bits, keys, r)

    schema = pa.schema([("low", pa.int64()), ("several", pa.binary()), ("many", pa.binary()), ("records", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, _ = _read(batches, _KEY)
        if not len(r):
            return
        r = r[np.argsort(r["m"], kind="stable")]
        cut = np.flatnonzero(_heads(r["m"]))
        several = np.minimum.reduceat(r["low"], cut) != np.maximum.reduceat(r["high"], cut)
        size = np.diff(np.append(cut, len(r)))
        hot = np.flatnonzero(size > HOT)
        many = np.stack([r["m"][cut[hot]], size[hot].astype(np.uint64)], 1).tobytes()
        for low, part in _parts(_place(r["m"][cut], bits), several, buckets, bits):
            yield pa.RecordBatch.from_pylist([{"low": low, "several": part, "many": many, "records": len(r)}], schema=schema)
            many, r = b"", r[:0]

    blobs = docs.select("doc_id", "text").mapInArrow(tidy(deal), _KIND)
    found = blobs.repartition(buckets, "bucket").mapInArrow(tidy(find), "low long, several binary, many binary, records long").collect()  # 2 ** bits bits, and 16 bytes for HOT records
    several = np.zeros((1 << bits) // 8, np.uint8)
    for r in found:
        several[r["low"] : r["low"] + len(r["several"])] |= np.frombuffer(r["several"], np.uint8)
    many = np.frombuffer(b"".join(r["many"] for r in found), np.uint64).reshape(-1, 2)
    return several, np.sort(many[many[:, 1] > sum(r["records"] for r in found) >> 20, 0])


class SuffixAutomaton:
    """Of several sequences; each state has the least document whose sequence holds its strings."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [1 << 62]

    def add(self, sequence: list[int], doc: int) -> None:
        nxt, link, length, least = self.next, self.link, self.length, self.least
        last = 0
        for c in sequence:
            p = nxt[last].get(c)
            if p is not None and length[p] == length[last] + 1:
                last = p
                if doc < least[p]:
                    least[p] = doc
                continue
            if p is not None:
                last = self._clone(last, p, c)
                least[last] = min(least[last], doc)
                continue
            new = len(nxt)
            nxt.append({}), link.append(0), length.append(length[last] + 1), least.append(doc)
            at = last
            while at != -1 and c not in nxt[at]:
                nxt[at][c] = new
                at = link[at]
            if at != -1:
                q = nxt[at][c]
                link[new] = q if length[q] == length[at] + 1 else self._clone(at, q, c)
            last = new

    def _clone(self, at: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q])), link.append(link[q]), length.append(length[at] + 1), self.least.append(1 << 62)
        link[q] = new
        while at != -1 and nxt[at].get(c) == q:
            nxt[at][c] = new
            at = link[at]
        return new

    def finish(self) -> None:
        """Hand the least documents down the suffix links."""
        for s in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            if self.least[s] < self.least[self.link[s]]:
                self.least[self.link[s]] = self.least[s]

    def windows(self, sequence: list[int], span: int = SPAN) -> list[int]:
        """The least document with each window of the sequence, by matching statistics; 1 << 62 if there is none."""
        nxt, link, length = self.next, self.link, self.length
        state = match = 0
        out = []
        for i, c in enumerate(sequence):
            while state and c not in nxt[state]:
                state = link[state]
                match = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                match += 1
            if i >= span - 1:
                if match >= span:
                    while length[link[state]] >= span:
                        state = link[state]
                    match = min(match, length[state])
                    out.append(self.least[state])
                else:
                    out.append(1 << 62)
        return out


def least_documents(r: np.ndarray, words: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Rules: key, segment, its occurrences and for each window the least document with it, where some occurrence has a smaller one.

    r: _SHARED records, of which several may be of one segment; words, lengths: theirs."""
    order = np.lexsort((r["seg"], r["m"]))
    begin, r = (np.cumsum(lengths) - lengths)[order], r[order]
    if not len(r):
        return
    heads = np.flatnonzero(_heads(r["m"], r["seg"]))
    low, high, count = np.minimum.reduceat(r["low"], heads), np.maximum.reduceat(r["high"], heads), np.add.reduceat(r["count"], heads)
    m, seg, begin, size = r["m"][heads], r["seg"][heads], begin[heads], lengths[order][heads]
    cut = np.flatnonzero(_heads(m))
    ends = np.append(cut, len(m))[1:]
    several = np.minimum.reduceat(low, cut) != np.maximum.reduceat(high, cut)
    for k in np.flatnonzero(several).tolist():
        a, b = int(cut[k]), int(ends[k])
        texts = [words[begin[s] : begin[s] + size[s]].tolist() for s in range(a, b)]
        automaton = SuffixAutomaton()
        for s, t in zip(range(a, b), texts):
            automaton.add(t, int(low[s]))
        automaton.finish()
        for s, t in zip(range(a, b), texts):
            found = np.array(automaton.windows(t), np.int64)
            if found.min() < high[s]:
                yield int(m[s]), int(seg[s]), int(count[s]), found


def covered(seen: np.ndarray, pairs: np.ndarray, found: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Windows, as _COVER runs, that a smaller document holds too. seen: _SEEN records; pairs (sorted), found, lengths: rules."""
    if not len(seen) or not len(pairs):
        return np.zeros(0, _COVER)
    own = _pairs(seen["m"], seen["seg"])
    at = np.minimum(np.searchsorted(pairs, own), len(pairs) - 1)
    mine = pairs[at] == own
    seen, at = seen[mine], at[mine]
    n = lengths[at]
    hit = _taken(found, (np.cumsum(lengths) - lengths)[at], n) < np.repeat(seen["doc"], n)
    whose = np.repeat(np.arange(len(seen)), n)
    place = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)
    hits = np.flatnonzero(hit)
    if not len(hits):
        return np.zeros(0, _COVER)
    new = np.ones(len(hits), bool)
    new[1:] = (np.diff(hits) > 1) | (whose[hits][1:] != whose[hits][:-1])
    begin = np.flatnonzero(new)
    out = np.empty(len(begin), _COVER)
    owner = seen[whose[hits[begin]]]
    out["doc"], out["row"], out["at"] = owner["doc"], owner["row"], owner["at"] + place[hits[begin]]
    out["n"] = np.diff(np.append(begin, len(hits)))
    return out


def _rules(docs: DataFrame, buckets: int, bits: int, shared) -> DataFrame:
    """pair, m, count, found of the segments that some document loses windows of."""
    keys = spread(buckets)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several, replaced = shared.value
        held, size = [], 0
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for m, seg, row, _, n, new, h, where in _segments(b, replaced):
                mine = np.flatnonzero(new | _among(m, several, bits))
                r = np.empty(len(mine), _SHARED)
                r["m"], r["seg"], r["low"], r["high"], r["count"], r["n"] = m[mine], seg[mine], ids[row[mine]], ids[row[mine]], 1, n[mine]
                lengths = n[mine] + SPAN - 1
                held.append((r, _taken(h, where[mine], lengths)))
                size += int(lengths.sum())
                if size > 4 * HELD:
                    yield _dealt(*_joined(held, buckets, bits, keys))
                    held, size = [], 0
        if held:
            yield _dealt(*_joined(held, buckets, bits, keys))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, words = _read(batches, _SHARED)
        out: list[tuple] = []
        for m, seg, count, found in least_documents(r, words, r["n"].astype(np.int64) + SPAN - 1):
            out.append((m, seg, count, found.tobytes()))
            if len(out) >= 10_000:
                yield _rule_batch(out)
                out = []
        if out:
            yield _rule_batch(out)

    return docs.select("doc_id", "text").mapInArrow(tidy(deal), _KIND).repartition(buckets, "bucket").mapInArrow(tidy(match), "pair long, m long, count long, found binary")


def _joined(held: list[tuple], buckets: int, bits: int, keys: list[int]) -> tuple:
    """What a task holds, one record for each key and segment with its words, as arguments of _dealt."""
    r, words = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
    lengths = r["n"].astype(np.int64) + SPAN - 1
    order = np.lexsort((r["seg"], r["m"]))
    begin, r = (np.cumsum(lengths) - lengths)[order], r[order]
    cut = np.flatnonzero(_heads(r["m"], r["seg"]))
    out = r[cut]
    if len(cut):
        out["low"], out["high"], out["count"] = np.minimum.reduceat(r["low"], cut), np.maximum.reduceat(r["high"], cut), np.add.reduceat(r["count"], cut)
    lengths = lengths[order][cut]
    return _place(out["m"], bits) * buckets >> bits, keys, out, lengths, _taken(words, begin[cut], lengths)


def _rule_batch(rows: list[tuple]) -> pa.RecordBatch:
    m, seg = (np.array([r[k] for r in rows], np.uint64) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(_pairs(m, seg).view(np.int64)), pa.array(m.view(np.int64)), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())], ["pair", "m", "count", "found"])


def _sorted_rules(pairs: list[int], found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules as covered() takes them."""
    p = np.array(pairs, np.int64).view(np.uint64)
    order = np.argsort(p, kind="stable")
    lengths = np.array([len(f) // 8 for f in found], np.int64)[order]
    return p[order], np.frombuffer(b"".join([found[k] for k in order.tolist()]), np.int64), lengths


def removed_spans(docs: DataFrame, buckets: int, bits: int) -> DataFrame:
    """doc_id, _row, spans: int32 pairs (first word, word after the last), apart and in order."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(shared_keys(docs, buckets, bits))
    release(spark)
    rules = checkpointed(_rules(docs, buckets, bits, shared))
    total = rules.agg(F.sum("count")).first()[0] or 0
    # no more than FREQUENT rules have so many of all occurrences
    often = rules.filter((F.col("count") > F.lit(total // FREQUENT)) & (F.length("found") <= 8 * FREQUENT_WINDOWS)).select("pair", "found").collect()
    ruled = np.zeros((1 << bits) // 8, np.uint8)
    place = rules.select((F.shiftrightunsigned("m", 64 - bits) + 1).alias("p"))
    for r in place.groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect():  # 2 ** bits bits
        ruled[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    frequent = spark.sparkContext.broadcast((ruled, _sorted_rules([r["pair"] for r in often], [bytes(r["found"]) for r in often])))
    keys = spread(buckets)
    by_pair = lambda p: (p % np.uint64(buckets)).astype(np.int64)

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, replaced = shared.value
        bitmap, (pairs, found, lengths) = frequent.value
        for b in batches:
            ids, rows = b.column("doc_id").to_numpy(), b.column("_row").to_numpy()
            for m, seg, row, at, n, *_ in _segments(b, replaced):
                mine = np.flatnonzero(_among(m, bitmap, bits))
                r = np.empty(len(mine), _SEEN)
                r["m"], r["seg"], r["doc"], r["row"], r["at"], r["n"] = m[mine], seg[mine], ids[row[mine]], rows[row[mine]], at[mine], n[mine]
                known = np.zeros(len(r), bool)
                own = _pairs(r["m"], r["seg"])
                if len(pairs):
                    known = pairs[np.minimum(np.searchsorted(pairs, own), len(pairs) - 1)] == own
                    runs = covered(r[known], pairs, found, lengths)
                    yield _decided(runs, buckets, keys)
                yield _dealt(by_pair(own[~known]), keys, r[~known])

    def deal_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column("pair").to_numpy()
            blobs = [p[i : i + 1].tobytes() + f for i, f in enumerate(b.column("found").to_pylist())]
            at = by_pair(p.view(np.uint64)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in at], pa.int32()), pa.array([b""] * len(at), pa.binary()), pa.array(blobs, pa.binary())], schema=_BLOBS)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, done, pairs, found = [], [], [], []
        for b in batches:
            for records, words in zip(b.column("records").to_pylist(), b.column("words").to_pylist()):
                if words == b"done":
                    done.append(records)
                elif words:
                    pairs.append(int.from_bytes(words[:8], "little", signed=True))
                    found.append(words[8:])
                else:
                    seen.append(records)
        runs = np.concatenate([np.frombuffer(b"".join(done), _COVER), covered(np.frombuffer(b"".join(seen), _SEEN), *_sorted_rules(pairs, found))])
        yield _dealt((mix64(runs["doc"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), keys, runs)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, _ = _read(batches, _COVER)
        r = r[np.lexsort((r["at"], r["row"], r["doc"]))]
        begin, end = r["at"].astype(np.int64), r["at"].astype(np.int64) + r["n"] + SPAN - 1
        first = np.ones(len(r), bool)
        first[1:] = (r["doc"][1:] != r["doc"][:-1]) | (r["row"][1:] != r["row"][:-1])
        cut = np.append(np.flatnonzero(first), len(r))
        ids, rows, spans = [], [], []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            reach = np.maximum.accumulate(end[a:b])
            gap = np.flatnonzero(begin[a + 1 : b] > reach[:-1])
            pairs = np.stack([begin[a:b][np.append(0, gap + 1)], reach[np.append(gap, b - a - 1)]], 1)
            ids.append(int(r["doc"][a])), rows.append(int(r["row"][a])), spans.append(pairs.astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(spans, pa.binary())], ["doc_id", "_row", "spans"])

    seen = docs.mapInArrow(tidy(see), _KIND).union(rules.select("pair", "found").mapInArrow(tidy(deal_rules), _KIND))
    runs = seen.repartition(buckets, "bucket").mapInArrow(tidy(decide), _KIND)
    return runs.repartition(buckets, "bucket").mapInArrow(tidy(merge), "doc_id long, _row long, spans binary")


def _decided(runs: np.ndarray, buckets: int, keys: list[int]) -> pa.RecordBatch:
    """Covered runs on their way to be merged."""
    dealt = _dealt((mix64(runs["doc"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), keys, runs)
    return pa.RecordBatch.from_arrays([dealt.column("bucket"), dealt.column("records"), pa.array([b"done"] * dealt.num_rows, pa.binary())], schema=_BLOBS)


def substring_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words that stay, joined by a space)."""
    d = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_row"))
    known = d.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    with settings(spark, **{CLEAN: "true"}):
        size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(28, max(16, math.ceil(math.log2(size / 2 + 1))))  # a segment has some 30 bytes
        spans = checkpointed(removed_spans(known, max(partitions(spark), -(-size // BUCKET)), bits))
    release(spark)
    # only texts that lose something are sent
    flagged = marked(d, spans, "_row")
    hit = flagged.filter("maybe").join(spans, ["doc_id", "_row"], "left").select("doc_id", "text", "spans")
    joined = flagged.filter("not maybe").select("doc_id", "text", F.lit(None).cast("binary").alias("spans")).union(hit)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                out = []
                for doc, text, s in zip(*(b.slice(i, 1000).column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                    words = (text or "").encode("utf-8", "surrogatepass").split()  # bytes split at space, tab, LF, VT, FF and CR
                    kept = words
                    if s:
                        pairs = np.frombuffer(s, np.int32).reshape(-1, 2).tolist()
                        kept = [w for (_, a), (z, _) in zip([(0, 0), *pairs], [*pairs, (len(words), 0)]) for w in words[a:z]]
                    rest = b" ".join(kept)
                    out.append((doc, len(words), len(words) - len(kept), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "surrogatepass")))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return joined.mapInArrow(tidy(cut), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
