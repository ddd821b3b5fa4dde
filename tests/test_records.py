import csv
import random

import pytest

from conftest import rows
from edaspark.sources import records, scan

CELLS = ["a", "bc", "", 'say "x"', "one\ntwo", "\n", "p,q", 'l1\nl2,"\n",', '",', "é\n\nf", "x\r\ny"]


@pytest.fixture
def small_splits(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "37")
    spark.conf.set("spark.sql.files.openCostInBytes", "9")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def write_csv(path, header, lines, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(header)
        w.writerows(lines)


@pytest.mark.parametrize("seed", range(4))
def test_records_over_many_splits(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    folder = tmp_path / "t.csv"
    folder.mkdir()
    want = []
    for k in range(3):
        header = rng.choice([["id", "b", "c"], ["c", "id", "b"]])
        lines = []
        for n in range(rng.choice([0, 1, 25])):
            row = {"id": f"r{k}.{n}", "b": rng.choice(CELLS), "c": rng.choice(CELLS)}
            lines.append([row[c] for c in header])
            want.append((row["id"], row["b"] or None, row["c"] or None))
        write_csv(folder / f"{k}.csv", header, lines, rng.choice(["\n", "\r\n"]))
    if want:
        found = scan.load(spark, str(folder)).select("id", "b", "c")
        assert sorted(rows(found), key=str) == sorted(want, key=str)


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_splits):
    lines = [[f"r{n}", "x\n" * (n % 5) + "y"] for n in range(60)]
    path = tmp_path / "t.csv"
    write_csv(path, ["id", "text"], lines)
    found = records.csv_records(spark, [str(path)])
    assert found.rdd.getNumPartitions() > 10
    assert sorted(rows(scan.load(spark, str(path)))) == sorted(map(tuple, lines))


def test_a_cell_longer_than_its_splits(spark, tmp_path, small_splits):
    lines = [["1", "\n".join(f"line {k}" for k in range(200))], ["2", "b"], ["3", "\n" * 100]]
    path = tmp_path / "t.csv"
    write_csv(path, ["id", "text"], lines)
    assert sorted(rows(scan.load(spark, str(path)))) == [(int(i), t) for i, t in lines]


def test_quotes_inside_bare_cells_are_plain(spark, tmp_path, small_splits):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n5" pipe,x\n"y\nz",6" pipe\n7"",8"\n', encoding="utf-8")
    assert sorted(rows(scan.load(spark, str(path)))) == [('5" pipe', "x"), ('7""', '8"'), ("y\nz", '6" pipe')]


def test_turns(spark):
    cases = {
        "a,b": records.SAME, 'a,"b"': records.SAME, 'a,"b': records.TURN, 'b",c': records.TURN, '"': records.TURN, 'a"b': records.SHUT,
        '"a""b': records.TURN, 'a,"b""': records.OPEN, '","': records.SAME, 'x","y': records.SAME, '""': records.SAME, '"",""': records.SAME,
    }

    def state(line, inside):
        # One character at a time.
        fresh, quoted, k = not inside, inside, 0
        while k < len(line):
            ch = line[k]
            if quoted:
                if ch == '"' and line[k + 1 : k + 2] == '"':
                    k += 1
                elif ch == '"':
                    quoted = False
                fresh = False
            elif ch == '"' and fresh:
                quoted, fresh = True, False
            else:
                fresh = ch == ","
            k += 1
        return quoted

    rng = random.Random(1)
    lines = [*cases, *("".join(rng.choice('a",') for _ in range(rng.randint(1, 9))) for _ in range(400))]
    frame = spark.createDataFrame([(x,) for x in lines], "value string")
    got = dict(rows(frame.select("value", records._turn(frame.value))))
    for line in lines:
        ends = (state(line, False), state(line, True))
        want = {(False, True): records.SAME, (True, False): records.TURN, (False, False): records.SHUT, (True, True): records.OPEN}[ends]
        assert got[line] == want, line
