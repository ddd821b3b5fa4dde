"""Tables of odd rows that every operator meets."""

# Nulls, empty and blank texts, a very long text, ties, repeated rows, line ends, other scripts.
LONG = " ".join(f"Word{k % 977} of{k % 31}" for k in range(20000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and then rests a while under the old tree."),
    (2, "the quick brown fox jumps over the lazy dog and then rests a while under the old tree."),
    (2, "the quick brown fox jumps over the lazy dog and then rests a while under the old tree."),
    (3, None),
    (4, ""),
    (5, " \t\n\x0b\x0c\r "),
    (None, "A text whose id is null, of some ten words in all, here."),
    (None, None),
    (6, LONG),
    (7, "Zeile eins über Straße\n\nZeile zwei\r\nZeile zwei ▁   \U0001f600\x00 end  "),
    (8, "one"),
    (9, "one two"),
]
SCHEMA = "doc_id long, text string, _row string, _id string, _text string, key int, fp int, c0 int, h1 int, score string, n_lines int, `ids` int, `a.b` int"


def odd(spark, rows=ROWS):
    return spark.createDataFrame([(*r, *["x"] * 3, *[0] * 4, "s", 0, 0, 0) for r in rows], SCHEMA).repartition(3)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
