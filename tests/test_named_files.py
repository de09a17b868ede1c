import os

import pytest
from pyspark.sql import functions as F

from docgraph.sources import named_files as nf


def files(path):
    return {f: open(f"{path}/{f}", encoding="utf-8").read() for f in os.listdir(path) if f[0] not in "_."}


def rows(spark, data, schema="who string, n long, line string"):
    return spark.createDataFrame(data, schema)


def test_groups_under_their_names(spark, tmp_path):
    df = rows(spark, [("a", 2, "y"), ("b", 1, None), ("a", 1, "x"), (None, 1, "z"), ("", 2, "ü")])
    nf.write(df, str(tmp_path / "o"), "who", F.col("line"), ["n"], ending=".txt")
    assert files(tmp_path / "o") == {"a.txt": "x\ny\n", "b.txt": "\n", "unnamed.txt": "z\nü\n"}
    assert os.path.exists(tmp_path / "o" / "_SUCCESS") and not [f for f in os.listdir(tmp_path / "o") if f.startswith("_staging")]


def test_hot_group_is_split_and_clashes_get_suffixes(spark, tmp_path):
    df = rows(spark, [("a", k, f"l{k}") for k in range(10)] + [("a__1", 0, "other")])
    out = str(tmp_path / "o")
    nf.write(df, out, "who", F.col("line"), ["n"], most=4, ending=".txt", spread=F.col("n"))
    got = files(out)
    assert set(got) == {"a.txt", "a__1.txt", "a__2.txt", "a__1__1.txt"}
    assert sorted(got.values()) == sorted(["l0\nl3\nl6\nl9\n", "l1\nl4\nl7\n", "l2\nl5\nl8\n", "other\n"])
    nf.write(rows(spark, [("a", 0, "later")]), out, "who", F.col("line"), ["n"], ending=".txt")
    assert files(out)["a__3.txt"] == "later\n" and len(files(out)) == 5
    nf.write(rows(spark, [("a", 0, "only")]), out, "who", F.col("line"), ["n"], ending=".txt", mode="overwrite")
    assert files(out) == {"a.txt": "only\n"}


def test_failing_task_leaves_no_file(spark, tmp_path):
    out = str(tmp_path / "o")
    nf.write(rows(spark, [("kept", 0, "k")]), out, "who", F.col("line"), ["n"])
    with pytest.raises(Exception, match="not a file name"):
        nf.write(rows(spark, [(f"f{k}", k, "x") for k in range(20)] + [("up/../down", 0, "x")]), out, "who", F.col("line"), ["n"])
    assert files(out) == {"kept": "k\n"} and sorted(os.listdir(out)) == ["_SUCCESS", "kept"]


def test_empty_tables_and_folders(spark, tmp_path):
    out = str(tmp_path / "o")
    nf.write(rows(spark, []), out, "who", F.col("line"), ["n"])
    assert files(out) == {} and nf.read(spark, out).count() == 0 and nf.read(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_ranges_give_every_line_once(spark, tmp_path, split):
    (tmp_path / "o").mkdir()
    texts = {"empty": b"", "one": b"abc", "blank": b"\n\nx\n\n", "long": b"s\n" + b"y" * 300 + b"\nend\n", "odd": "größe\n\nß".encode() + b"\xff\n"}
    for name, x in texts.items():
        (tmp_path / "o" / name).write_bytes(x)
    want = []
    for name, x in texts.items():
        at = 0
        for line in x.split(b"\n")[: None if x and not x.endswith(b"\n") else -1]:
            want.append((name, at, line.decode("utf-8", "replace")))
            at += len(line) + 1
    assert sorted(tuple(r) for r in nf.read(spark, str(tmp_path / "o"), split).collect()) == sorted(want)


@pytest.mark.parametrize("block", [1, 3, 5, 1000])
def test_blocks_do_not_cut_lines(tmp_path, block):
    x = b"ab\n\ncdefgh\ni\nlast"
    (tmp_path / "f").write_bytes(x)
    store, path = nf.opened(str(tmp_path / "f"))
    for split in (1, 2, 4, 50):
        got = []
        for start in range(0, len(x), split):
            with store.open_input_file(path) as f:
                for b in nf._lines(f, "f", start, min(len(x), start + split), block):
                    got += list(zip(b.column("at").to_pylist(), b.column("value").to_pylist()))
        assert got == [(0, "ab"), (3, ""), (4, "cdefgh"), (11, "i"), (13, "last")]
