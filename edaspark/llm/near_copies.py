"""Near copies by word shingles: MinHash bands find candidates, exact Jaccard similarity over shingles decides.

A text's words (as in simhash_anchors) make shingles of five words; fewer words make one shingle. Texts of equal
words are one node. A node has BANDS band values of ROWS MinHash values each, so two nodes of similarity s share a
band with probability 1 - (1 - s ** ROWS) ** BANDS: 0.99993 at 0.8. A link is a pair of nodes that share a band and whose sets of
distinct shingles (by 64-bit hashes) have at least ``similarity``; nothing is dropped without one. Components of links are whole:
of each, one row stays. Links between two nodes that are joined already aren't looked for, as they change nothing.

Pairs that the caller names come first (the pipeline's: families of near SimHash fingerprints). Then families, in two waves (the first few bands, then the others): the nodes of a band value, in order of size, meet the
smallest node, and the first that is too large for it takes over, so each node is compared once per band value at most, and not
at all with one it is joined to. Band values of more than HOT nodes are dealt in parts, whose leaders meet afterwards.

Then what is left: nodes that share a band value with one of another component. Two sets of that similarity share one of their
rarest fifth of shingles, whatever the order of rarity, so these nodes meet by those shingles only. Rarity is the count of a shingle's
bucket over these nodes, BUCKETS of them. Sizes and the places of the shingle in both sets rule out most pairs unseen. So texts
that share 60 % of their words with thousands of others meet by the words that are their own, which are rare. Pairs still grow with the
square of the members where large components with hardly anything of their own are just under the limit from each other.

No word at all (null, empty, blank) is one node too. The row that stays is that of the smallest id, null ids last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import materialise_table
from .common import LOWER, components, identified, let_go, majority_bits

SEED = 42
SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
# Members that one task compares with a leader; those of a fuller one are split.
MEMBERS = 256
# Candidate texts up to which their digests are broadcast.
BROADCAST = 1_000_000
# Bands of each wave, nodes of a band value that one task takes, buckets in which shingles are counted.
WAVES = ((0, 4), (4, BANDS))
HOT, BUCKETS = 4096, 1 << 20

_keys = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)
FACTORS, SALTS = _keys[0] | np.uint64(1), _keys[1]
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; none without a word."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(words) - shingle + 1)
    starts, ends = starts[:last], ends[-last:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """The band values of a set of shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for start in range(0, len(hashes), 1 << 12):
        part = hashes[start : start + (1 << 12), None]
        least = np.minimum(least, ((part ^ SALTS) * FACTORS).min(0))
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX
    for row in least.reshape(BANDS, ROWS).T:
        out = (out ^ row) * MIX
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _words(text: bytes | None) -> tuple[int, list[bytes]]:
    """The node of a text, and its words."""
    words = (text or b"").translate(LOWER).split()
    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), SEED)).view(np.int64)), words


def _nodes(docs: DataFrame, id_column: str, text_column: str, shingle: int) -> DataFrame:
    """(node, o: what orders nodes, and names the row to be kept, m: number of shingles, fp: SimHash fingerprint, keys: band values)."""
    texts = identified(docs, id_column, text_column).select("_id", "_digest", "_text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            nodes, sizes, prints, keys = [], [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                node, words = _words(text)
                hashes = shingles(words, shingle)
                nodes.append(node), sizes.append(len(hashes)), prints.append(majority_bits(hashes)), keys.append(bands(hashes) if len(hashes) else [])
            out = [*batch.columns[:2], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64))]
            yield pa.record_batch([*out, pa.array(keys, pa.list_(pa.int64()))], names=["_id", "_digest", "node", "m", "fp", "keys"])

    schema = texts.selectExpr("_id", "_digest", "0L as node", "0 as m", "0L as fp", "array(0L) as keys").schema
    order = F.struct(F.col("_id").isNull().alias("x"), "_id", "_digest", "node")
    found = texts.mapInArrow(rows, schema).groupBy("node").agg(F.min(order).alias("o"), *[F.first(c).alias(c) for c in ("m", "fp", "keys")])
    return materialise_table(found)


def _sets(docs: DataFrame, id_column: str, text_column: str, shingle: int, wanted: DataFrame) -> DataFrame:
    """(node, s: hashes of its shingles) of the texts with the wanted digests (one column _of)."""
    few = wanted.count() <= BROADCAST
    texts = identified(docs, id_column, text_column).select("_digest", "_text")
    texts = texts.join(F.broadcast(wanted) if few else wanted, texts["_digest"] == wanted["_of"], "left_semi").select("_text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, sets = [], []
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                node, words = _words(text)
                if node not in seen:
                    seen.add(node)
                    nodes.append(node), sets.append(shingles(words, shingle).view(np.int64))
            yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "s"])

    return materialise_table(texts.mapInArrow(rows, "node long, s array<long>").groupBy("node").agg(F.first("s").alias("s")))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose similarity is high enough; a leader's members are compared in parts."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    parts = materialise_table(parts)
    members = pairs.join(parts, "a").join(sets, F.col("b") == F.col("node"))
    members = members.select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b", "s", F.lit(False).alias("leads"))
    leaders = parts.join(sets, F.col("a") == F.col("node"))
    leaders = leaders.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("b"), "s", F.lit(True).alias("leads"))
    dealt = members.unionAll(leaders).repartition("a", "part").sortWithinPartitions("a", "part", F.desc("leads"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.empty(0, np.int64)
        for batch in batches:
            out = []
            values, ends = batch.column(3).values.to_numpy(), batch.column(3).offsets.to_numpy()
            for k, (a, b, leads) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 4)))):
                s = values[ends[k] : ends[k + 1]].view(np.uint64)
                if leads:
                    own = s.copy()
                elif similarity_of(own, s) >= similarity:
                    out.append((a, b))
            yield pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(rows, "a long, b long")


def _leaders(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Stream rows sorted by (key, part, m): (a, b) of a leader and a node of another root; leaders of split keys, with no a."""
    last, lead = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, part, m, node, root = (batch.column(k).to_numpy() for k in range(5))
        split = batch.column(5).to_numpy(zero_copy_only=False)
        follows = np.empty(len(key), bool)
        follows[0] = last == (key[0], part[0])
        follows[1:] = (key[1:] == key[:-1]) & (part[1:] == part[:-1])
        pairs, leads = [], np.flatnonzero(~follows & split).tolist()
        for k in np.flatnonzero(follows).tolist():
            if k and not follows[k - 1]:
                lead = m[k - 1], node[k - 1], root[k - 1]
            if m[k] * (similarity - 1e-9) > lead[0]:
                lead = m[k], node[k], root[k]
                if split[k]:
                    leads.append(k)
            elif root[k] != lead[2]:
                pairs.append((int(lead[1]), int(node[k])))
        last = key[-1], part[-1]
        if not follows[-1]:
            lead = m[-1], node[-1], root[-1]
        pairs = list(dict.fromkeys(pairs))
        at, none = np.array(leads, np.int64), len(pairs)
        yield pa.record_batch(
            [
                pa.array([a for a, _ in pairs] + [None] * len(at), pa.int64()), pa.array([b for _, b in pairs] + node[at].tolist(), pa.int64()),
                pa.array([0] * none + key[at].tolist(), pa.int64()), pa.array([0] * none + m[at].tolist(), pa.int32()),
                pa.array([0] * none + root[at].tolist(), pa.int64()),
            ],
            names=["a", "b", "key", "m", "root"],
        )


def _family_pairs(nodes: DataFrame, start: int, stop: int, similarity: float) -> DataFrame:
    """(a, b) to be compared, of nodes (node, m, root, keys) that share one of these bands."""
    visits = nodes.select(F.explode(F.slice("keys", start + 1, stop - start)).alias("key"), "m", "node", "root")
    full = materialise_table(visits.groupBy("key").count().filter(F.col("count") > HOT))
    if not full.isEmpty():
        full = full.select("key", F.ceil(F.col("count") / HOT).cast("int").alias("parts"))
        visits = visits.join(full, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    else:
        visits = visits.withColumn("parts", F.lit(1))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    visits = visits.select("key", part.alias("part"), "m", "node", "root", (F.col("parts") > 1).alias("split"))

    def met(rows: DataFrame) -> DataFrame:
        dealt = rows.repartition("key", "part").sortWithinPartitions("key", "part", "m", "node")
        return dealt.mapInArrow(lambda batches: _leaders(batches, similarity), "a long, b long, key long, m int, root long")

    first = materialise_table(met(visits))
    leads = first.filter("a is null").select("key", F.lit(0).alias("part"), "m", F.col("b").alias("node"), "root", F.lit(False).alias("split"))
    pairs = first.filter("a is not null").select("a", "b")
    return (pairs if full.isEmpty() else pairs.unionAll(met(leads).select("a", "b"))).distinct()


def _rare(sets: DataFrame, similarity: float) -> DataFrame:
    """(s, m, place, node, root): each set's rarest shingles, enough of them to share one with every set that is similar."""
    bucket = F.pmod(F.col("s"), F.lit(BUCKETS)).cast("int")
    counts = sets.select(F.explode("s").alias("s")).groupBy(bucket.alias("k")).count().toArrow()
    often = np.zeros(BUCKETS, np.int64)
    often[counts.column("k").to_numpy()] = counts.column("count").to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(often)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                s = batch.column(2)[k].values.to_numpy()
                n = max(1, len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1)
                first = s[np.lexsort((s, shared.value[s % BUCKETS]))[:n]]
                column = lambda x, t: pa.array(np.full(len(first), x), t)  # noqa: E731, B023
                yield pa.record_batch(
                    [
                        pa.array(first), column(len(s), pa.int32()), pa.array(np.arange(len(first)), pa.int32()),
                        column(batch.column(0)[k].as_py(), pa.int64()), column(batch.column(1)[k].as_py(), pa.int64()),
                    ],
                    names=["s", "m", "place", "node", "root"],
                )

    return sets.select("node", "root", "s").mapInArrow(rows, "s long, m int, place int, node long, root long")


def _crossing(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Stream rows of ``_rare`` sorted by (s, m): (a, b) of different roots that may be similar by their sizes and places."""
    held = [np.empty(0, np.int64)] * 5

    def pairs(s, m, place, node, root):
        bounds = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True])))
        for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if stop - start < 2 or (root[start:stop] == root[start]).all():
                continue
            ends = start + np.searchsorted(m[start:stop], m[start:stop] / (similarity - 1e-9), "right")
            for k, end in enumerate(ends.tolist(), start):
                rest = slice(k + 1, end)
                most = 1 + np.minimum(m[k] - place[k] - 1, m[rest] - place[rest] - 1)
                open_ = (root[rest] != root[k]) & (most >= similarity / (1 + similarity) * (m[k] + m[rest]) - 1e-9)
                found = node[rest][open_]
                if len(found):
                    yield np.minimum(found, node[k]), np.maximum(found, node[k])

    def out(rows):
        a, b, n = [], [], 0
        for x, y in pairs(*rows):
            a.append(x), b.append(y)
            n += len(x)
            if n > 1 << 16:
                yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                a, b, n = [], [], 0
        if n:
            yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    for batch in batches:
        now = [np.concatenate((h, batch.column(k).to_numpy().astype(np.int64))) for k, h in enumerate(held)]
        changes = np.flatnonzero(now[0][1:] != now[0][:-1]) + 1
        cut = int(changes[-1]) if len(changes) else 0
        if cut:
            yield from out([x[:cut] for x in now])
        held = [x[cut:] for x in now]
    if len(held[0]):
        yield from out(held)


def _open_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that share a band value with a node of another root."""
    visits = nodes.select("node", "root", F.explode("keys").alias("key"))
    keys = visits.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    return materialise_table(visits.join(keys, "key", "left_semi").select("node").distinct())


def near_copies(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY,
    first: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(_id, _digest) of one row of each component: of the smallest id, a null id only where there is no other.

    ``first`` may name pairs (a, b) of nodes (node, m, fp) to be compared before any others; what they join is compared no more.
    """
    nodes = _nodes(docs, id_column, text_column, shingle)

    def rooted(roots: DataFrame | None) -> DataFrame:
        if roots is None:
            return nodes.withColumn("root", F.col("node"))
        return nodes.join(roots.toDF("_node", "_root"), F.col("node") == F.col("_node"), "left").withColumn("root", F.coalesce("_root", "node"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        digests = nodes.join(wanted, "node", "left_semi").select(F.col("o._digest").alias("_of")).distinct()
        return _sets(docs, id_column, text_column, shingle, materialise_table(digests))

    def linked(pairs: DataFrame, sets: DataFrame | None = None) -> bool:
        pairs = materialise_table(pairs)
        if pairs.isEmpty():
            return False
        if sets is None:
            sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        found.append(materialise_table(_verified(pairs, sets, similarity)))
        return True

    found: list[DataFrame] = []
    roots = None
    if first and linked(first(nodes.select("node", "m", "fp"))):
        roots = components(reduce(DataFrame.unionAll, found))
    for start, stop in WAVES:
        if linked(_family_pairs(rooted(roots), start, stop, similarity)):
            roots = components(reduce(DataFrame.unionAll, found))
    left = _open_nodes(rooted(roots))
    if not left.isEmpty():
        sets = sets_of(left)
        rare = _rare(sets.join(rooted(roots).select("node", "root"), "node"), similarity)
        dealt = rare.repartition("s").sortWithinPartitions("s", "m", "node")
        if linked(dealt.mapInArrow(lambda batches: _crossing(batches, similarity), "a long, b long").distinct(), sets):
            roots = components(reduce(DataFrame.unionAll, found))
    return rooted(roots).groupBy("root").agg(F.min("o").alias("o")).select("o._id", "o._digest")
