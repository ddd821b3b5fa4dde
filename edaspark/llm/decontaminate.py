"""Benchmark decontamination by word windows, with DataFrame functions only.

Words are runs of characters other than ASCII punctuation, white space and controls, A-Z in lower
case. An item's windows are its runs of ``width`` words; an item of fewer, but some, is one window.
Document words inside any occurrence of a window are hit.

A window set of checked size is broadcast: a bit map of its hashes, of fixed size for a size of set, filters
window positions inside each row; the few that pass carry their words to a broadcast join that compares the
words themselves. A larger set meets all positions in a shuffled join on the same words. Both give the same.

Null or empty texts have no words; an empty benchmark hits nothing. Repeated rows are judged each; repeated items
count once by id, items with a null id are hit but not counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import materialise_table
from .common import at, identified, lower_ascii, sealed

# Fixed value: what separates words.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Distinct windows up to which the set is broadcast (about 100 bytes each), and bits of the map per window.
BROADCAST_WINDOWS = 100_000
BITS_PER_WINDOW = 256


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text", width: int = 10) -> DataFrame:
    """(window, length, items): distinct windows, their words space-joined, and the ids of the items that have them."""
    items = sealed(benchmark).select(at(benchmark, id_column).alias("_item"), words_of(at(benchmark, text_column).cast("string")).alias("_w"))
    items = items.filter(F.size("_w") > 0).withColumn("length", F.least(F.size("_w"), F.lit(width)))
    places = F.explode(F.sequence(F.lit(1), F.size("_w") - F.col("length") + 1)).alias("_at")
    windows = items.select("_item", "length", "_w", places).withColumn("window", F.array_join(F.slice("_w", F.col("_at"), F.col("length")), " "))
    return windows.groupBy("window", "length").agg(F.collect_set("_item").alias("items"))


def _positions(length: int, bits: list[int] | None) -> str:
    """SQL: structs (at, length, window) of a row's windows of a length, those that the bit map passes."""
    windows = f"if(size(_w) >= {length}, sequence(0, size(_w) - {length}), cast(array() as array<int>))"
    window = f"array_join(slice(_w, {{at}} + 1, {length}), ' ')"
    made = f"named_struct('at', {{at}}, 'length', {length}, 'window', {window})"
    if bits is None:
        return f"transform({windows}, i -> {made.format(at='i')})"
    held = f"cast(split('{','.join(map(str, bits))}', ',') as array<bigint>)"
    hashed = f"transform({windows}, i -> named_struct('at', i, 'h', xxhash64(slice(_w, i + 1, {length}))))"
    test = f"(shiftright(get({held}, int(shiftrightunsigned(s.h, 6) & {len(bits) - 1})), int(s.h & 63)) & 1) = 1"
    return f"transform(filter({hashed}, s -> {test}), s -> {made.format(at='s.at')})"


def _bit_map(hashes: list[int], n: int) -> list[int]:
    """Longs whose bits mark the hashes; as many as BITS_PER_WINDOW asks for, a power of two."""
    words = [0] * (1 << max(4, (n * BITS_PER_WINDOW // 64 - 1).bit_length()))
    for h in hashes:
        words[(h & 0xFFFFFFFFFFFFFFFF) >> 6 & len(words) - 1] |= 1 << (h & 63)
    return [w - (1 << 64) if w >> 63 else w for w in words]


def _spans(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
    item_text_column: str = "text", width: int = 10, broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """(_id, _digest, n_words, spans, items) of every row."""
    windows = materialise_table(benchmark_windows(benchmark, item_column, item_text_column, width))
    sizes = {r.length: r["count"] for r in windows.groupBy("length").count().collect()}
    small = sum(sizes.values()) <= broadcast_windows
    texts = identified(docs, id_column, text_column).select("_row", "_id", "_digest", words_of(F.col("_text")).alias("_w"))
    parts = []
    for length, n in sorted(sizes.items()):
        bits = None
        if small:
            own = windows.filter(F.col("length") == length).select(F.xxhash64(F.split("window", " ")).alias("h"))
            bits = _bit_map([r.h for r in own.collect()], n)
        parts.append(_positions(length, bits))
    none = "cast(array() as array<struct<at:int,length:int,window:string>>)"
    # A row without any candidate keeps a place that joins to nothing, under a key of its own.
    found = texts.selectExpr("_row", "_id", "_digest", "size(_w) as n_words", f"concat({', '.join([none, *parts])}) as _c")
    found = found.selectExpr("_row", "_id", "_digest", "n_words", "explode_outer(_c) as c").selectExpr("_row", "_id", "_digest", "n_words", "c.*")
    if not small:
        found = found.withColumn("window", F.coalesce("window", F.concat(F.lit(" "), F.col("_row").cast("string"))))
    held = windows.select("window", "length", "items")
    hits = found.join(F.broadcast(held) if small else held, ["window", "length"], "left")
    hits = hits.groupBy("_row", "_id", "_digest", "n_words").agg(
        F.sort_array(F.collect_list(F.when(F.col("items").isNotNull(), F.struct("at", "length")))).alias("spans"),
        F.collect_set(F.when(F.size("items") > 0, F.col("items"))).alias("items"),
    )
    items = F.transform(F.array_distinct(F.flatten("items")), lambda i: i.cast("string"))
    return hits.select("_id", "_digest", F.col("n_words").cast("long").alias("n_words"), "spans", F.sort_array(items).alias("items"))


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", **settings) -> DataFrame:
    """(id, n_words, spans: sorted (at, length) of occurrences, items: sorted distinct ids as text) of every row."""
    spans = _spans(docs, benchmark, id_column, **settings)
    return spans.select("_id", "n_words", "spans", "items").toDF(id_column, "n_words", "spans", "items")


def hit_words(spans: str = "spans") -> Column:
    """Words covered by sorted spans, each word once."""
    merge = (
        f"aggregate({spans}, named_struct('n', 0L, 'end', 0), (a, s) -> named_struct("
        "'n', a.n + greatest(0, s.at + s.length - greatest(a.end, s.at)), 'end', greatest(a.end, s.at + s.length)), a -> a.n)"
    )
    return F.expr(merge)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **settings) -> DataFrame:
    """All columns of the documents without any hit."""
    spans = _spans(docs, benchmark, id_column, text_column, **settings)
    hit = spans.filter(F.size("spans") > 0).select("_id", "_digest").distinct()
    own = sealed(docs).withColumn("_of", F.xxhash64(at(docs, text_column).cast("string")))
    same = at(docs, id_column).eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_digest"))
    return own.join(hit, same, "left_anti").drop("_of").toDF(*docs.columns)
