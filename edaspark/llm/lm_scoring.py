"""Prediction by partial matching over bytes, trained on a corpus, scoring whole documents.

A text is its words in lower case (A-Z), joined by single spaces, and an end. Each byte is predicted
from the ``order`` bytes before it by a trie of byte contexts. At a context with n occurrences
and d known successors, a known byte s has probability (count(s) - 1/2) / n, and the escape to the next
shorter context has the rest: d / 2. After an escape the
successors known to the longer context are excluded from the shorter one's counts (symbol exclusion); below the empty
context the remaining bytes are equally likely. Probabilities of all bytes after any context sum to 1.

Every context and successor of the training texts is known, however rare. Counts are exact and come from one shuffled sum, which
also has the grams (a context and a byte) of the other texts. A gram's probability is worked out once: of those that were trained from
the count and the context's sum, of the others by joins with the contexts of one depth at a time. The ``held`` most frequent
grams are broadcast with their probabilities; a document's other grams meet theirs in a join. ``held`` changes no result.

``max_nodes``, if given, makes a smaller model that is broadcast whole: of each depth it knows only nodes that make up at least
1 / ``max_nodes`` of all training positions, and the occurrences of other successors go to the escape.

Beside it stands the add-one unigram score of the words. Words of at least 1 / HOT of the training tokens
(at most HOT words) are broadcast; a document's rarer words meet the vocabulary in a join.

A null or blank text is its end alone. A null id is in no fold, so it trains. Repeated rows train and score each. Without any
training text every byte has probability 1/256 and every word count 0.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import materialise_table
from .common import LOWER, Table, identified, kept

# The end of a text, and what precedes its first byte; canonical text has no line end of its own.
END = 10
ORDER = 6
# Grams that a worker holds.
MAX_NODES = 1 << 21
# What each known successor of a context gives to the escape.
DISCOUNT = 0.5
HOT = 1 << 17
# Bytes of text that a task counts or scores at a time, and counts held before equal ones are added up.
CHUNK, MERGED = 1 << 20, 1 << 22
# Places (a power of two) for probabilities that a worker remembers, of grams that the trie doesn't hold.
REMEMBERED = 1 << 20
# Grams whose contexts are broadcast to find their successors.
ASKED = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def canonical(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER).split()


def grams_of(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of order + 1 bytes ending at every byte and end of the joined texts, packed into longs; how many each text has."""
    pad = bytes([END]) * order
    end = bytes([END])
    data = np.frombuffer(b"".join(x for t in texts for x in (pad, t, end)) or b"", np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    if not len(texts):
        return np.empty(0, np.int64), sizes
    keys = np.zeros(len(data) - order, np.int64)
    for k in range(order + 1):
        keys = (keys << 8) | data[k : len(data) - order + k]
    # Of the places between two texts, the ones inside the next text's padding are none.
    starts = np.cumsum(sizes + order) - (sizes + order)
    real = np.ones(len(keys), bool)
    for k in range(1, order + 1):
        before = starts[1:] - k
        real[before] = False
    return keys[real], sizes


def _pieces(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in runs of about CHUNK bytes; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > CHUNK:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


@dataclass(frozen=True)
class Trie:
    """By depth k: grams of k + 1 bytes with counts; contexts of k bytes with what their probabilities need."""

    order: int
    grams: tuple[np.ndarray, ...]
    counts: tuple[np.ndarray, ...]
    contexts: tuple[np.ndarray, ...]
    total: tuple[np.ndarray, ...]  # occurrences of the context
    held: tuple[np.ndarray, ...]  # of these, followed by a known successor
    known: tuple[np.ndarray, ...]  # known successors
    above: tuple[np.ndarray, ...]  # occurrences of the next shorter context followed by these successors

    @classmethod
    def build(cls, order: int, grams: dict[int, tuple[np.ndarray, np.ndarray]], contexts: dict[int, tuple[np.ndarray, np.ndarray]]) -> Trie:
        """From (keys, counts) of grams and of contexts by depth."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        out = {name: [] for name in ("grams", "counts", "contexts", "total", "held", "known", "above")}
        for k in range(order + 1):
            keys, counts = grams.get(k, none)
            sort = np.argsort(keys)
            keys, counts = keys[sort], counts[sort]
            of, first = np.unique(keys >> 8, return_index=True)
            all_keys, all_totals = contexts.get(k, none)
            sort = np.argsort(all_keys)
            out["grams"].append(keys)
            out["counts"].append(counts)
            out["contexts"].append(of)
            out["total"].append(all_totals[sort][np.searchsorted(all_keys[sort], of)])
            sums = lambda x: np.add.reduceat(x, first) if len(first) else np.empty(0, np.int64)  # noqa: E731, B023
            out["held"].append(sums(counts))
            out["known"].append(sums(np.ones_like(counts)))
            shorter = keys & ((1 << 8 * k) - 1)
            out["above"].append(sums(out["counts"][k - 1][np.searchsorted(out["grams"][k - 1], shorter)]) if k else np.zeros_like(of))
        return cls(order, **{k: tuple(v) for k, v in out.items()})


class Model:
    """A trie with the tables that scoring looks things up in; one is made per worker."""

    def __init__(self, trie: Trie):
        self.trie, k = trie, trie.order
        at = np.searchsorted(trie.contexts[k], trie.grams[k] >> 8)
        self.whole = np.log10((trie.counts[k] - DISCOUNT) / trie.total[k][at])
        self.gram_tables = [Table(g) for g in trie.grams]
        self.context_tables = [Table(c) for c in trie.contexts]
        self.remembered, self.values = np.full(REMEMBERED, -1, np.int64), np.zeros(REMEMBERED)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each packed gram's last byte after the ones before."""
        place = self.gram_tables[-1].find(keys)
        out = self.whole[place] if len(self.whole) else np.zeros(len(keys))
        miss = np.flatnonzero(place < 0)
        if len(miss):
            distinct, back = np.unique(keys[miss], return_inverse=True)
            out[miss] = self._remembered(distinct)[back]
        return out

    def _remembered(self, keys: np.ndarray) -> np.ndarray:
        """``_backed_off`` of distinct grams; each has one place to be remembered at, and takes it over."""
        slot = ((keys.view(np.uint64) * MIX) >> np.uint64(32)).astype(np.int64) & (len(self.remembered) - 1)
        out = self.values[slot]
        new = np.flatnonzero(self.remembered[slot] != keys)
        if len(new):
            out[new] = self._backed_off(keys[new])
            # Of new grams with one place the last takes it.
            place, last = np.unique(slot[new][::-1], return_index=True)
            last = new[len(new) - 1 - last]
            self.remembered[place], self.values[place] = keys[last], out[last]
        return out

    def _backed_off(self, keys: np.ndarray) -> np.ndarray:
        t = self.trie
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        excluded, gone = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)  # occurrences, and successors
        for k in range(t.order, -1, -1):
            own = keys[left] & ((1 << 8 * (k + 1)) - 1)
            at = self.context_tables[k].find(own >> 8)
            seen = at >= 0
            take = lambda x: np.where(seen, x[at], 0) if len(x) else np.zeros(len(at), np.int64)  # noqa: E731, B023
            total, held, known = take(t.total[k]), take(t.held[k]), take(t.known[k])
            free = np.where(seen, total - excluded[left], 0)
            place = self.gram_tables[k].find(own)
            hit = place >= 0
            some = free > 0
            count = np.where(hit, t.counts[k][place] - DISCOUNT, 0) if len(t.counts[k]) else np.zeros(len(own))
            escape = total - held + DISCOUNT * (known - gone[left])
            share = np.where(hit, count, np.where(some, escape, 1)) / np.where(some, free, 1)
            out[left] += np.log10(share)
            # What this context knows is excluded from the next; an unseen one excludes what it had to.
            excluded[left] = np.where(seen, take(t.above[k]), 0)
            gone[left] = np.where(seen, known, 0)
            left = left[~hit]
        out[left] -= np.log10(256 - gone[left])
        return out

    def score(self, texts: list[bytes]) -> list[float]:
        out: list[float] = []
        for run in _pieces(texts):
            keys, sizes = grams_of(run, self.trie.order)
            out += np.add.reduceat(self.log10(keys), np.cumsum(sizes) - sizes).tolist()
        return out

    def parts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``Frequent.parts``; nothing is left to be looked up elsewhere."""
        none = np.empty(0, np.int64)
        return np.array(self.score(texts), float), none, none, none


class Frequent:
    """Grams with the log10 of their probabilities, those that are held; one is made per worker."""

    def __init__(self, order: int, grams: np.ndarray, log10: np.ndarray):
        self.order, self.table, self.log10 = order, Table(grams), np.append(log10, 0.0)  # at -1, what isn't held adds nothing

    def parts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The sum over the grams that are held, of each text; then the others: places of their texts, grams, times."""
        sums, of, grams, times, before = [np.empty(0)], [], [], [], 0
        for run in _pieces(texts):
            keys, sizes = grams_of(run, self.order)
            place = self.table.find(keys)
            sums.append(np.add.reduceat(self.log10[place], np.cumsum(sizes) - sizes))
            left = np.flatnonzero(place < 0)
            distinct, which = np.unique(keys[left], return_inverse=True)
            pairs, n = np.unique((np.searchsorted(np.cumsum(sizes), left, "right") << 32) | which, return_counts=True)
            of.append((pairs >> 32) + before), grams.append(distinct[pairs & 0xFFFFFFFF]), times.append(n)
            before += len(run)
        join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return np.concatenate(sums), join(of), join(grams), join(times)


def model_of(name: str, made: tuple) -> Model | Frequent:
    """One model per worker process, kept between tasks."""
    return kept(name, lambda: Model(*made) if isinstance(made[0], Trie) else Frequent(*made))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    sort = np.argsort(keys)
    keys = keys[sort]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts[sort], first)


def _rows_of(keys: pa.Array, counts: np.ndarray, words: bool) -> Iterator[pa.RecordBatch]:
    """Small batches, whatever a task has counted; counts have those of training texts in their lower half."""
    for start in range(0, len(keys), 1 << 16):
        key, both = keys[start : start + (1 << 16)], counts[start : start + (1 << 16)]
        none = pa.nulls(len(key), pa.int64() if words else pa.binary())
        word, gram = (key, none) if words else (none, key)
        yield pa.record_batch([word, gram, pa.array(both & 0xFFFFFFFF), pa.array(both >> 32)], names=["word", "gram", "n", "others"])


def count_corpus(docs: DataFrame, text_column: str, order: int, training: Column | None = None) -> DataFrame:
    """(word, context, gram, n, others): counts of all words (the end is a line end) and of all grams, one of the two null.

    n counts rows that ``training`` is true for, by default all, and words are theirs only; others counts grams of the other rows.
    A context's grams, without their last byte all the same, are in one partition.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A batch has under 2^31 bytes, so that both counts of a gram fit into one long.
        for batch in batches:
            n_taught = batch.column(1).true_count
            words: Counter[bytes] = Counter({bytes([END]): n_taught} if n_taught else {})
            keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
            for start in range(0, batch.num_rows, 256):
                texts: tuple[list[bytes], list[bytes]] = [], []
                part = batch.slice(start, 256)
                for text, taught in zip(part.column(0).cast(pa.binary()).to_pylist(), part.column(1).to_pylist()):
                    tokens = canonical(text)
                    if taught:
                        words.update(tokens)
                    texts[not taught].append(b" ".join(tokens))
                for half, some in enumerate(texts):
                    for run in _pieces(some):
                        found = np.unique(grams_of(run, order)[0], return_counts=True)
                        keys, counts = np.concatenate((keys, found[0])), np.concatenate((counts, found[1] << 32 * half))
                if len(keys) > MERGED:
                    keys, counts = _summed(keys, counts)
                    if len(keys) > MERGED // 2:  # hardly anything equal: held no longer, but added up by Spark
                        yield from _rows_of(pa.array(keys), counts, False)
                        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
            keys, counts = _summed(keys, counts)
            yield from _rows_of(pa.array(list(words), pa.binary()), np.fromiter(words.values(), np.int64, len(words)), True)
            yield from _rows_of(pa.array(keys), counts, False)

    taught = F.lit(True) if training is None else F.coalesce(training, F.lit(False))
    # Tasks have added up what they could, so nothing is gained by adding up again before the shuffle.
    parts = docs.select(F.col(text_column), taught.alias("taught"))
    parts = parts.mapInArrow(rows, "word binary, gram long, n long, others long")
    parts = parts.repartition("word", F.shiftright("gram", 8)).withColumn("context", F.shiftright("gram", 8))
    return parts.groupBy("word", "context", "gram").agg(F.sum("n").alias("n"), F.sum("others").alias("others"))


def _trie(grams: DataFrame, order: int, max_nodes: int) -> Trie:
    """The nodes of each depth with their share of all positions; each depth has at most ``max_nodes``."""
    positions = grams.agg(F.sum("n")).first()[0] or 0
    least = max(1, -(-positions // max_nodes))
    kinds = [f"struct({k} as depth, false as context, gram & {(1 << 8 * (k + 1)) - 1}L as key)" for k in range(order + 1)]
    kinds += [f"struct({k} as depth, true as context, shiftright(gram, 8) & {(1 << 8 * k) - 1}L as key)" for k in range(order + 1)]
    nodes = grams.selectExpr("n", f"explode(array({', '.join(kinds)})) as e").selectExpr("e.*", "n")
    nodes = nodes.groupBy("depth", "context", "key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toArrow()
    depth, context, key, n = (nodes.column(c).to_numpy() for c in ("depth", "context", "key", "n"))
    of = lambda k, c: (key[(depth == k) & (context == c)], n[(depth == k) & (context == c)])
    return Trie.build(order, *({k: of(k, c) for k in range(order + 1)} for c in (False, True)))


def _step_down(last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For grams that have met their context of some depth: what it gives them, or the escape from it, at the last one from the trie.

    ``next`` has the context's successors, their counts above the byte, and is null where it was never seen; excluded has a bit for each
    successor of the longer context.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                gram, log10 = batch.column("gram").to_numpy(), batch.column("log10").to_numpy()
                bits = np.frombuffer(b"".join(batch.column("excluded").to_pylist()), np.uint8).reshape(-1, 32)
                sizes, successors = batch.column("next").value_lengths().fill_null(0).to_numpy(), batch.column("next").flatten().to_numpy()
                counts = np.zeros((len(gram), 256), np.int64)
                counts[np.repeat(np.arange(len(gram)), sizes), successors & 255] = successors >> 8
                own = counts[np.arange(len(gram)), gram & 255]
                left = np.where(np.unpackbits(bits, axis=1), 0, counts)
                n, known = left.sum(1), np.count_nonzero(left, 1)
                share = np.where(own > 0, own - DISCOUNT, np.where(n > 0, DISCOUNT * known, 1)) / np.where(n > 0, n, 1)
                if last:
                    share = np.where(own > 0, share, share / np.maximum(256 - np.count_nonzero(counts, 1), 1))
                excluded = pa.array([row.tobytes() for row in np.packbits(counts > 0, axis=1)], pa.binary())
                yield pa.record_batch(
                    [batch.column("gram"), batch.column("times"), pa.array(log10 + np.log10(share)), excluded, pa.array((own > 0) | last)],
                    names=["gram", "times", "log10", "excluded", "found"],
                )

    return rows


def _escaped(grams: DataFrame, order: int) -> DataFrame:
    """(gram, times, log10) of the grams that no training text has, by their contexts of one depth after the other."""
    left = grams.filter("n = 0").selectExpr("gram", "others as times", "0D as log10", f"X'{'00' * 32}' as excluded")
    schema, columns = left.selectExpr("*", "false as found").schema, left.columns
    nodes, done = grams.filter("n > 0").select("gram", "n"), []
    for k in range(order, -1, -1):
        n_left = left.count()
        if not n_left:
            break
        if k < order:
            nodes = materialise_table(nodes.groupBy(F.expr(f"gram & {(1 << 8 * (k + 1)) - 1}L").alias("gram")).agg(F.sum("n").alias("n")))
        left = left.withColumn("context", F.expr(f"shiftright(gram, 8) & {(1 << 8 * k) - 1}L"))
        asked = left.select("context").distinct()
        asked = F.broadcast(asked) if n_left <= ASKED else asked
        contexts = nodes.withColumn("context", F.shiftright("gram", 8)).join(asked, "context", "left_semi").groupBy("context")
        contexts = contexts.agg(F.expr("collect_list(shiftleft(n, 8) | (gram & 255))").alias("next"))
        # Below a depth of two there are at most 256 contexts, and all grams may share them.
        contexts = F.broadcast(contexts) if k < 2 else contexts
        after = materialise_table(left.join(contexts, "context", "left").mapInArrow(_step_down(k == 0), schema))
        done.append(after.filter("found").select("gram", "times", "log10"))
        left = after.filter("not found").select(columns)
    return reduce(DataFrame.unionAll, done, left.select("gram", "times", "log10"))


def _likely(grams: DataFrame, order: int) -> DataFrame:
    """(gram, times, log10) of all grams: how often they occur, anywhere, and their probability."""
    seen = grams.filter("n > 0").selectExpr("gram", "n + others as times", f"log10((n - {DISCOUNT}D) / total) as log10")
    return seen.unionAll(_escaped(grams.select("gram", "n", "others"), order))


def _frequent(likely: DataFrame, order: int, held: int) -> tuple[tuple, DataFrame]:
    """What ``Frequent`` is made of, of at most ``held`` grams (by an eighth of an octave of their times); the other grams."""
    level = F.floor(8 * F.log2("times"))
    least, so_far = 1 << 10, 0
    for r in sorted(likely.groupBy(level.alias("level")).count().collect(), reverse=True):
        so_far += r["count"]
        if so_far > held:
            break
        least = r.level
    often = likely.filter(level >= least).select("gram", "log10").toArrow()
    return (order, *(often.column(c).to_numpy() for c in ("gram", "log10"))), likely.filter(level < least).select("gram", "log10")


def score_documents(
    docs: DataFrame, training: Column | None = None, id_column: str = "doc_id", text_column: str = "text", order: int = ORDER,
    max_nodes: int | None = None, hot: int = HOT, *, held: int = MAX_NODES,
) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row; both scores are log10 probabilities.

    ``training`` says, over the column ``_id``, which rows the model learns from; by default all.
    """
    texts = identified(docs, id_column, text_column)
    counts = count_corpus(texts, "_text", order, training)
    counts = materialise_table(counts.withColumn("total", F.sum("n").over(Window.partitionBy("word", "context"))).drop("context"))
    words, grams = counts.filter("word is not null").select("word", "n"), counts.filter("gram is not null").drop("word")
    if max_nodes is None:
        made, others = _frequent(_likely(grams, order), order, held)
        looked_up = words.selectExpr("word", "-1L as gram", "n", "0D as log10").unionAll(others.selectExpr("X'' as word", "gram", "0L as n", "log10"))
    else:
        made = (_trie(grams.filter("n > 0").select("gram", "n"), order, max_nodes),)
        looked_up = words.selectExpr("word", "-1L as gram", "n", "0D as log10")
    n_train, n_words = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    space = n_train + n_words + 1  # add-one over the vocabulary and one unknown word
    often = (F.col("n") >= max(1, -(-n_train // hot))) & (F.octet_length("word") <= 64)
    frequent = words.filter(often | (F.col("word") == F.lit(bytes([END])))).collect()
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((made, {bytes(w): n for w, n in frequent}))
    name = uuid.uuid4().hex

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, known = shared.value
        model = model_of(name, made)
        weight = {w: math.log10((n + 1) / space) for w, n in known.items()}
        end = weight.get(bytes([END]), math.log10(1 / space))
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                words_, times, sizes, n_tokens, joined = [], [], [], [], []
                for text in batch.column(2).cast(pa.binary()).to_pylist():
                    tokens = canonical(text)
                    counted = Counter(tokens)
                    words_ += counted.keys()
                    times += counted.values()
                    sizes.append(len(counted)), n_tokens.append(len(tokens) + 1), joined.append(b" ".join(tokens))
                of, times = np.repeat(np.arange(len(sizes)), sizes), np.array(times, np.int64)
                weights = np.fromiter(map(weight.get, words_, repeat(np.nan)), float, len(words_))
                rare = np.isnan(weights)
                sums = lambda x: np.bincount(of, x, len(sizes))  # noqa: E731, B023
                n_known = sums(np.where(rare, 0, times)).astype(np.int64) + int(bytes([END]) in known)
                base = sums(np.where(rare, 0, times * weights)) + end
                row, id_ = batch.column(0), batch.column(1)
                score, of_gram, grams_, gram_times = model.parts(joined)
                # A document's own row carries a gram below -1, so that it joins to nothing, anywhere; a word's carries -1, a gram's no word.
                own, n_rare, n_grams = -2 - row.to_numpy(), int(rare.sum()), len(grams_)
                places = pa.array(np.concatenate((np.arange(len(own)), of[rare], of_gram)))
                zeros = np.zeros(n_rare + n_grams, np.int64)
                column = lambda x, rest=zeros: pa.array(np.concatenate((x, rest)))
                yield pa.record_batch(
                    [
                        row.take(places), id_.take(places),
                        pa.array([b""] * len(own) + list(compress(words_, rare.tolist())) + [b""] * n_grams, pa.binary()),
                        pa.array(np.concatenate((own, np.full(n_rare, -1), grams_))),
                        pa.array(np.concatenate((np.zeros(len(own), np.int64), times[rare], gram_times))),
                        column(np.array(n_tokens, np.int64)), column(n_known), column(base), column(score),
                    ],
                    names=schema.names,
                )

    plain = texts.select("_row", "_id", "_text")
    schema = plain.selectExpr("_row", "_id", "binary(_text) as word", "0L as gram", "0L as times", "0L as n_tokens", "0L as n_known", "0D as base", "0D as score").schema
    # The vocabulary and the grams are hashed, a part of them in each task: sorting both sides would cost more than all that follows.
    rows_ = plain.mapInArrow(rows, schema).join(looked_up.hint("shuffle_hash"), ["word", "gram"], "left")
    rare = F.when(F.col("gram") == -1, F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(space)))).otherwise(0)
    is_known = (F.col("gram") == -1) & F.col("n").isNotNull()
    out = rows_.groupBy("_row", "_id").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(is_known, F.col("times")).otherwise(0)).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        F.sum(F.col("base") + rare).alias("base_score"),
        F.sum(F.col("score") + F.when(F.col("gram") >= 0, F.col("times") * F.col("log10")).otherwise(0)).alias("score"),
    )
    return out.drop("_row").toDF(id_column, "n_tokens", "n_known", "train_tokens", "base_score", "score")
