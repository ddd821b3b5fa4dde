"""Spelling variants: words one edit apart, found by a frontier of states that walks down a distributed trie.

The trie is a table of the edges out of nodes that several words share, each with the number of words below its child, bits of the symbols
that follow there, and, where a single word does, hashes of that word's rest. A state is (word, position, node, edits); a level
joins the states at nodes of one depth with the edges out of those nodes and writes the states of the next. Without an edit a state goes on
along its own symbol; an edit takes another edge instead of the word's symbol, or before it, or skips the symbol.
After the edit only the word's own symbols lead on. An edge whose bits lack the word's next symbols is not taken, and
one to a single word is settled by its hashes at once, so few states outlive a level. At the end symbol the node's word is a neighbour.

Words go in forwards and backwards. Forwards an edit may stand behind the first half of the word only, backwards behind the other
half, where nodes have few children. Of all places that give the same neighbour the first mismatch is taken, so each neighbour is found once.

Nodes with many words are split: their rows are repeated, once for every PART words below, and states choose one by the word's hash.
No broadcast grows with the data: only the nodes at the depth where words set out are, of which the alphabet allows some 16,000.
Words beyond LONG code points, which would need a level each for their symbols, meet by hashes of themselves without one symbol.
Hashes have 128 bits (LONG words: 93).

``word_counts`` takes runs of letters from texts; null, empty and blank texts have none, repeated rows count each. In ``spelling_groups``
rows without a word are left out and counts of the same word are added. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import discard, materialise_table, table_path
from .common import LOWER, identified

# Fixed value: what a word is made of, after A-Z is lowered.
LETTERS = "[a-zÀ-ÿ]+"
# Words a task counts before it hands them on.
HELD = 200_000
# Words below a node for each of its parts.
PART = 4096
LONG = 64
END = "$"
PRIMES, BASE = (2147483647, 2147483629, 2147483587), 1_000_003


def word_counts(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = 5, min_count: int = 3, misspell: int | None = None
) -> DataFrame:
    """(word, n) of all texts, A-Z lowered, with so many code points and occurrences at least.

    ``misspell`` plants errors as cases for the search: of a run where it divides h, the crc32 of `id:run`, the letter h % length goes;
    runs of rows without an id stay.
    """
    texts = identified(docs, id_column, text_column).select(F.col("_id").cast("string").alias("_id"), F.col("_text").cast("binary"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = re.compile(LETTERS), Counter()

        def flushed() -> pa.RecordBatch:
            long = {w: n for w, n in held.items() if len(w) >= min_chars}
            held.clear()
            return pa.record_batch([pa.array(long.keys(), pa.string()), pa.array(long.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words.findall((text or b"").translate(LOWER).decode(errors="replace"))
                if misspell is None or id_ is None:
                    held.update(found)
                else:
                    start = crc32(f"{id_}:".encode())
                    for word, n in Counter(found).items():
                        h = crc32(word.encode(), start)
                        if h % misspell == 0:
                            word = word[: h % len(word)] + word[h % len(word) + 1 :]
                        held[word] += n
                if len(held) > HELD:
                    yield flushed()
        yield flushed()

    counts = texts.mapInArrow(rows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= min_count)


def _hashes(rest: Column) -> tuple[Column, Column]:
    return F.xxhash64(rest), F.xxhash64(F.lit(1), rest)


def _at(text: str, place: Column | str) -> Column:
    """The symbol at a place counted from 0; empty beyond the end."""
    return F.substring(F.col(text), (F.col(place) if isinstance(place, str) else place) + 1, F.lit(1))


def _rest(place: Column, n: int | None = None) -> Column:
    """What a word has from a place on, whole or the first few symbols."""
    return F.substring(F.col("t"), place + 1, F.lit(n) if n else F.char_length("t"))


def _bit(place: Column, n: int) -> Column:
    """One of 64 for the next symbols from a place on."""
    return F.pmod(F.xxhash64(_rest(place, n)), F.lit(64))


def _mask(place: Column, n: int) -> Column:
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _bit(place, n).cast("int")))


def _trie(words: DataFrame, depth: int) -> DataFrame:
    """Edges (depth, node, c, part, parts, words, n, r1, r2, two, four) from a depth on out of nodes that several words share.

    A node is named by its prefix, which holds the mark of the direction. An edge tells of the words below its child: how many, the bits of
    the two and of the four symbols that follow, and, of a single word, its count and hashes of its rest. parts is the node's.
    """
    spelt = words.select("t", "n", F.explode(F.sequence(F.lit(depth + 1), F.char_length("t") - 1)).alias("d"))
    behind = F.col("d") + 1
    one, other = _hashes(_rest(behind))
    edges = spelt.groupBy(F.substring(F.col("t"), F.lit(1), F.col("d")).alias("node"), _at("t", "d").alias("c")).agg(
        F.count("*").alias("words"),
        F.sum("n").alias("n"),
        F.bit_xor(one).alias("r1"),
        F.bit_xor(other).alias("r2"),
        _mask(behind, 2).alias("two"),
        _mask(behind, 4).alias("four"),
    )
    edges = edges.withColumn("total", F.sum("words").over(Window.partitionBy("node"))).filter("total > 1")
    parts = F.ceil(F.col("total") / PART).cast("int")
    edges = edges.withColumns({"depth": F.char_length("node"), "parts": parts}).drop("total")
    return edges.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))


def _has(mask: str, bits: str, k: int) -> Column:
    """Whether a mask has the k-th of the packed bits of a state."""
    return F.expr(f"(shiftright({mask}, cast((shiftright({bits}, {6 * k}) & 63) as int)) & 1) = 1")


def _step(states: DataFrame, edges: DataFrame) -> DataFrame:
    """Neighbours found, and states of the next depth, of the states at some nodes: (t, p, node, edits, parts, n: null unless found)."""
    states = states.withColumn("part", F.pmod(F.xxhash64("t"), F.col("parts")).cast("int")).drop("parts", "n")
    places = [F.col("p") + k for k in range(3)]
    packed = sum((_bit(place, n) * F.lit(1 << (12 * k + 6 * (n == 4))) for k, place in enumerate(places) for n in (2, 4)), F.lit(0).cast("long"))
    states = states.withColumn("bits", packed)
    edges = edges.select("node", "part", "c", "words", "n", "r1", "r2", "two", "four")
    alike = lambda k: _has("two", "bits", 2 * k) & _has("four", "bits", 2 * k + 1)

    # After the edit the word's own symbol alone leads on.
    after = states.filter("edits = 1").withColumn("c", _at("t", "p")).join(edges, ["node", "part", "c"])
    after = after.withColumn("move", F.when(F.col("c") == END, -1).when(alike(1), 1)).filter("move is not null")

    # Half of a word, forwards rounded down, backwards up, counted behind the mark of direction; t ends in END.
    chars = F.char_length("t") - 2
    half = F.when(F.startswith("t", F.lit("<")), F.floor(chars / 2)).otherwise(F.ceil(chars / 2)) + 1
    before = states.filter("edits = 0").withColumns({"own": _at("t", "p"), "next": _at("t", F.col("p") + 1), "may": F.col("p") >= half})
    before = before.join(edges, ["node", "part"])
    same, inner, inside = F.col("c") == F.col("own"), F.col("c") != END, F.col("own") != END
    moves = F.array(
        F.when(same & inner & (F.col("words") > 1), 3),  # no edit
        F.when(~same & F.col("may") & inner & inside & alike(1), 1),  # another symbol instead
        F.when(~same & F.col("may") & inner & alike(0), 0),  # one more symbol
        F.when(~same & F.col("may") & inner & (F.col("c") == F.col("next")) & alike(2), 2),  # a symbol skipped
        F.when(~same & F.col("may") & ~inner & inside & (F.col("next") == END), -1),  # the last symbol skipped
    )
    before = before.withColumn("move", F.explode(moves)).filter("move is not null")

    keep = ["t", "p", "node", "c", "words", "n", "r1", "r2", "move"]
    met = after.select(*keep).unionAll(before.select(*keep))
    place = F.col("p") + F.when(F.col("move") == 3, 1).otherwise(F.col("move"))
    single = (F.col("words") == 1) & F.col("move").between(0, 2)
    one, other = _hashes(_rest(place))
    met = met.filter(~single | ((F.col("r1") == one) & (F.col("r2") == other)))
    over = F.col("move") == -1
    child = F.concat("node", "c")
    reached = F.when(over, F.col("node")).when(single, F.concat(child, F.substring(F.col("t"), place + 1, F.char_length("t") - place - 1)))
    return met.select(
        "t", place.alias("p"), reached.otherwise(child).alias("node"), F.when(F.col("move") == 3, 0).otherwise(1).alias("edits"),
        F.ceil(F.col("words") / PART).cast("int").alias("parts"), F.when(over | single, F.col("n")).alias("n"),
    )


def _without_each(word: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a word without each of its symbols, and of the whole word last, in two numbers."""
    codes, keys = np.fromiter(map(ord, word), np.int64, len(word)), []
    for prime in PRIMES:
        powers, k = np.ones(len(codes), np.int64), 1
        while k < len(powers):
            more = powers[k : 2 * k]
            more[:] = powers[: len(more)] * pow(BASE, k, prime) % prime
            k *= 2
        sums = np.cumsum(np.append(0, codes * powers % prime)) % prime
        keys.append(np.append((sums[:-1] + (sums[-1] - sums[1:]) % prime * pow(BASE, -1, prime)) % prime, sums[-1]))
    return (keys[0] << 32) | keys[1], keys[2]


def _long_pairs(words: DataFrame) -> DataFrame:
    """(word, near, n of near) where one of both is longer than LONG: equal hashes after a symbol was left out."""

    names = ["place", "size", "ka", "kb", "wa", "wb"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word in batch.column(0).to_pylist():
                ka, kb = _without_each(word)
                places = np.append(np.arange(len(word)), -1)
                columns = (places, len(word) - (places >= 0), ka, kb, np.full(len(ka), ka[-1]), np.full(len(kb), kb[-1]))
                yield pa.record_batch([*map(pa.array, columns)], names)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(word), *(int(k[-1]) for k in _without_each(word))) for word in batch.column(0).to_pylist()]
            yield pa.record_batch([*batch.columns, *(pa.array(c, pa.int64()) for c in (list(zip(*found)) or [()] * 3))], ["word", "n", "size", "wa", "wb"])

    long = words.filter(F.char_length("word") >= LONG)
    keyed = materialise_table(long.select("word").mapInArrow(rows, ", ".join(f"{c} long" for c in names)))
    key = ["size", "ka", "kb"]
    # Words are told apart by (length, wa, wb) here, as their texts are as long as their rows are many.
    less = keyed.filter("place >= 0").select("place", *key, F.struct(F.col("size") + 1, "wa", "wb").alias("w"))
    whole = keyed.filter("place < 0").select(*key, F.struct("size", "wa", "wb").alias("x"))
    shorter = less.join(whole, key).select("w", "x").distinct()
    # With one place left out at most the alphabet's letters differ.
    replaced = less.join(less.withColumnRenamed("w", "x"), [*key, "place"]).filter("w <> x").select("w", "x")
    pairs = shorter.unionAll(shorter.select("x", "w")).unionAll(replaced)
    texts = long.select("word", "n").mapInArrow(named, "word string, n long, size long, wa long, wb long")
    left = texts.select(F.struct("size", "wa", "wb").alias("w"), "word")
    right = texts.select(F.struct("size", "wa", "wb").alias("x"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = pairs.join(left, "w").join(right, "x").select("word", "near", "near_n")
    return pairs.filter((F.char_length("word") > LONG) | (F.char_length("near") > LONG))


def near_words(words: DataFrame, path: str | None = None) -> DataFrame:
    """(word, near, near_n) of all pairs, both ways, one inserted, deleted or replaced code point apart.

    Words are distinct, their symbols letters of LETTERS, and the caller keeps them where they can be read again cheaply. The pairs are
    written to ``path`` (see ``materialise_table``).
    """
    spark = words.sparkSession
    bounds = words.agg(F.min(F.char_length("word")), F.max(F.char_length("word"))).first()
    empty = spark.createDataFrame([], "word string, near string, near_n long")
    if bounds[0] is None:
        return empty
    entry, deepest = bounds[0] // 2, min(bounds[1], LONG)
    short = words.filter(F.char_length("word") <= LONG)
    both = F.explode(F.array(F.concat(F.lit("<"), "word", F.lit(END)), F.concat(F.lit(">"), F.reverse("word"), F.lit(END)))).alias("t")
    spelt = short.select(both, "n")
    paths = [table_path(spark)]
    _trie(spelt, entry).write.partitionBy("depth").parquet(paths[0])
    kinds = "node string, c string, words long, n long, r1 long, r2 long, two long, four long, parts int, part int, depth int"
    edges = spark.read.schema(kinds).parquet(paths[0])
    # All nodes of this depth: at most the alphabet's size to the power of ``entry``, which for words of five letters is 8,100, times two.
    first = edges.filter((F.col("depth") == entry + 1) & (F.col("part") == 0)).select("node", "parts").distinct()
    first = F.broadcast(first) if entry <= 2 else first
    states = spelt.withColumn("node", F.substring(F.col("t"), F.lit(1), F.lit(entry + 1))).join(first, "node")
    states = states.select("t", F.lit(entry + 1).alias("p"), "node", F.lit(0).alias("edits"), "parts", F.lit(None).cast("long").alias("n"))
    schema = "t string, p int, node string, edits int, parts int, n long"
    for depth in range(entry + 1, deepest + 2):
        paths.append(table_path(spark))
        _step(states, edges.filter(F.col("depth") == depth)).write.parquet(paths[-1])
        states = spark.read.schema(schema).parquet(paths[-1]).filter("n is null")
        if states.isEmpty():
            break
    found = spark.read.schema(schema).parquet(*paths[1:]).filter("n is not null")
    forwards = F.startswith("t", F.lit("<"))
    plain = F.substring(F.col("t"), F.lit(2), F.char_length("t") - 2)
    near = F.substring(F.col("node"), F.lit(2), F.char_length("node"))
    found = found.select(
        F.when(forwards, plain).otherwise(F.reverse(plain)).alias("word"), F.when(forwards, near).otherwise(F.reverse(near)).alias("near"),
        F.col("n").alias("near_n"), forwards.alias("forwards"),
    )
    half = F.floor(F.char_length("word") / 2).cast("int")
    # What agrees up to its half was found forwards.
    twice = ~F.col("forwards") & (F.substring(F.col("word"), F.lit(1), half) == F.substring(F.col("near"), F.lit(1), half))
    pairs = found.filter(~twice).drop("forwards")
    if bounds[1] > LONG:
        pairs = pairs.unionAll(_long_pairs(words))
    pairs = materialise_table(pairs, path)
    for path in paths:
        discard(spark, path)
    return pairs


def spelling_groups(words: DataFrame, ratio: int = 2, rounds: int = 64) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n).

    A word's form is its near word of largest n (ties: the smallest word), if that n is ``ratio`` times the word's own or more; its root is
    where the forms end. With a ratio of 2, chains are no longer than the logarithm of the largest count.
    """
    held = [table_path(words.sparkSession), table_path(words.sparkSession)]
    words = materialise_table(words.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n")), held[0])
    pairs = near_words(words, held[1])
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    rows = words.join(best, "word", "left")
    form = F.when(-F.col("best.m") >= ratio * F.col("n"), F.col("best.near"))
    rows = rows.select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form.isNotNull(), -F.col("best.m")).alias("form_n"))
    rows = materialise_table(rows)
    for path in held:
        discard(words.sparkSession, path)
    forms = rows.filter("form is not null").select(F.col("word").alias("at"), F.col("form").alias("to"))
    # Words whose form has a form of its own move on until none has.
    ends, moving = [], rows.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        moved = materialise_table(moving.join(forms, moving.root == forms["at"], "left").select("word", "root", "to"))
        ends.append(moved.filter("to is null").select("word", "root"))
        moving = moved.filter("to is not null").select("word", F.col("to").alias("root"))
        if moving.isEmpty():
            break
    else:
        raise RuntimeError(f"forms did not end in {rounds} rounds")
    roots = ends[0]
    for more in ends[1:]:
        roots = roots.unionAll(more)
    out = rows.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
