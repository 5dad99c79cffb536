"""Quoted tables cut at any place against Spark's own reader, which takes a file in one task."""

import random

import pytest
from pyspark.sql import functions as F

from conceptmine import schemas
from conceptmine.sinks import export
from conceptmine.sources import records, tables

FIELDS = ["plain", "", 'say "hi"', "a;b", "two\nlines", "\n", "x\n\n\ny", '"', '""\n"', "é" * 40, "long " * 30, "tab\t", " lead", "#c"]


def quoted(value):
    return '"' + value.replace('"', '""') + '"' if any(c in value for c in ';"\n\r') or value == "" else value


def text_table(seed, n, end="\n"):
    rnd = random.Random(seed)
    rows = [[rnd.choice(FIELDS) for _ in range(6)] for _ in range(n)]
    rows += [["a", "\n" * 900, "b" * 2000, "", 'q"' * 300, "z"]] * 2
    rnd.shuffle(rows)
    head = ";".join(schemas.MATCH.fieldNames())
    return rows, end.join([head, *(";".join(map(quoted, r)) for r in rows)]) + end


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda size: (spark.conf.set("spark.sql.files.maxPartitionBytes", str(size)), spark.conf.set("spark.sql.files.openCostInBytes", "0"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", [100, 517, 4096, 1 << 27])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_any_split_gives_the_same_rows(spark, tmp_path, small_splits, size, end):
    rows, text = text_table(size, 150, end)
    (tmp_path / "m.csv").write_bytes(text.encode())
    small_splits(size)
    df = records.read_quoted(spark, str(tmp_path / "m.csv"), schemas.MATCH, ";")
    # an empty field is read as null, quoted or not
    got = sorted(tuple(x or "" for x in r) for r in df.collect())
    assert got == sorted(map(tuple, rows))
    if size < 4096:
        assert records._lines(spark, str(tmp_path / "m.csv")).rdd.getNumPartitions() > 5


def test_folder_of_files_with_blank_lines_and_no_last_line_end(spark, tmp_path, small_splits):
    for i in range(3):
        rows, text = text_table(i, 30)
        (tmp_path / f"part-{i}.csv").write_text("\n" + text.replace("\nplain;", "\n\n\nplain;")[:-1], newline="")
    small_splits(200)
    got = records.read_quoted(spark, str(tmp_path), schemas.MATCH, ";")
    want = spark.read.csv(str(tmp_path), schema=schemas.MATCH, sep=";", header=True, quote='"', escape='"', multiLine=True)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and got.count() > 80


def test_match_table_round_trip_in_both_forms(spark, tmp_path, small_splits):
    rows = [(f"p{i}/a.py", "/fw/m.C", "P;1" if i % 3 else None, "name", f'line "{i}"\nnext; {i}', i / 8) for i in range(200)]
    df = spark.createDataFrame(rows, "file_path string, concept_name string, pattern string, match_type string, "
                                     "matched_text string, similarity_score double")
    folder, text = str(tmp_path / "matches"), str(tmp_path / "text")
    export.write_matches(df.coalesce(1), folder, text)
    small_splits(1000)
    want = tables.with_origin(df)
    for back in (tables.read_matches(spark, text), tables.read_match_table(spark, folder)):
        assert back.exceptAll(want).count() == 0 and want.exceptAll(back).count() == 0
    assert tables.read_matches(spark, text).select(F.spark_partition_id()).distinct().count() > 3
    with pytest.raises(FileNotFoundError):
        tables.read_match_table(spark, str(tmp_path / "none"))


def test_empty_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    assert records.read_quoted(spark, str(tmp_path / "e.csv"), schemas.MATCH).count() == 0
    with pytest.raises(ValueError):
        tables.read_matches(spark, str(tmp_path / "e.csv"))


def test_scripts_with_bad_bytes_and_unreadable_files(spark, tmp_path):
    from pyspark.sql import Observation

    from conceptmine.sources import scan
    (tmp_path / "p").mkdir()
    files = {"good.py": "a = 'é'\r\nb\rc\n".encode(), "bad.py": b"x = '\xff\xfe'\r\ny\n", "empty.py": b"", "none.txt": b"z"}
    for name, content in files.items():
        (tmp_path / "p" / name).write_bytes(content)
    seen = Observation()
    got = {r.path: (r.project, r.text) for r in scan.scan_scripts(spark, str(tmp_path), seen=seen).collect()}
    assert got == {"p/good.py": ("p", "a = 'é'\nb\nc\n"), "p/bad.py": ("p", "x = ''\ny\n")}
    assert seen.get == {"files": 2, "bad": 1} and scan.unreadable(spark, str(tmp_path), "*.py", seen) == 0
    strict = {r.path for r in scan.scan_scripts(spark, str(tmp_path), strict=True).collect()}
    assert strict == {"p/good.py"}
    # a file that goes after it was listed: the scan leaves it out, the count shows it
    lost = Observation()
    rows = scan.scan_scripts(spark, str(tmp_path), seen=lost)
    (tmp_path / "p" / "bad.py").unlink()
    assert rows.count() == 1
    (tmp_path / "p" / "bad.py").write_bytes(files["bad.py"])
    assert scan.unreadable(spark, str(tmp_path), "*.py", lost) == 1


def test_python_sees_files_with_bad_bytes_only(spark, tmp_path):
    from conceptmine.sources import scan
    (tmp_path / "a.py").write_bytes(b"x")
    plan = scan.scan_scripts(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "CASE WHEN NOT is_valid_utf8" in plan


def test_bad_bytes_go_as_in_python_without_a_worker(spark):
    import random

    from conceptmine.sources import scan
    rnd = random.Random(5)
    pieces = [b"a\r\nb", "é".encode(), "€".encode(), "\U0001F600".encode(), "�".encode(), b"\xff", b"\xe2\x82", b"\xf0\x9f\x98", b"\xc0\xaf",
              b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\x80", b"\r", b"$1\\", b"\x00"]
    given = [b"".join(rnd.choices(pieces, k=rnd.randrange(12))) for _ in range(400)] + [None, b"", b"x" * 300_000 + b"\xff"]
    df = spark.createDataFrame(list(enumerate(given)), "i int, content binary").select("i", scan.decode_lenient(F.col("content")).alias("text"))
    want = [b if b is None else b.decode("utf-8", errors="ignore").replace("\r\n", "\n").replace("\r", "\n") for b in given]
    assert [r.text for r in df.orderBy("i").collect()] == want
    assert "Eval" not in df._jdf.queryExecution().executedPlan().toString()


def test_files_of_a_task_have_folders_of_their_own(spark):
    from pathlib import Path

    from workload import files
    rows = spark.range(40, numPartitions=4).selectExpr("if(id % 2 = 0, 'a', null) AS kind", "'t' || id AS value")
    root = Path(files.one_file_each(rows, ["kind"]))
    found = list(root.glob("kind=*/_task=*/*.txt"))
    assert sorted(f.read_text() for f in found) == sorted(f"t{i}\n" for i in range(40))
    assert len({f.parent for f in found}) == 8 and not list(root.rglob("*.txt.crc"))


@pytest.mark.parametrize("starts, look", [(64, 10_000), (2, 10_000), (64, 3)])
def test_tasks_list_what_sparks_reader_lists(spark, tmp_path, monkeypatch, starts, look):
    from conceptmine.sources import scan
    monkeypatch.setattr(scan, "_STARTS", starts)
    monkeypatch.setattr(scan, "_LOOK", look)
    names = ["a.py", "b c.py", "é'\"%20.py", "[x].py", "_h.py", "_metadata.py", "_k=1.py", ".dot.py", "n.txt", "n.md", "z._COPYING_"]
    folders = ["", "p", "p/q", "p/q/r r", "p/build", "_h", ".git", "_part=1", "_metadata_x", "w/1", "w/2", "w/3", "w/4"]
    for folder in folders:
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        for name in names:
            (tmp_path / folder / name).write_bytes(f"# {folder}{name}".encode() + b"\r\n\xff")
        (tmp_path / folder / "empty.py").touch()
    for root, glob, skip in ((str(tmp_path), "*", None), (f"file://{tmp_path}/", "*.{py,txt}", ["build", "a.py"]), (f"{tmp_path}/p", "[a-b]*", None)):
        want = scan._spark_files(spark, root, glob, skip)
        assert sorted(scan.list_files(spark, root, glob, skip).collect()) == sorted(want.drop("content").collect())
        assert sorted(scan.scan_files(spark, root, glob, skip).collect()) == sorted(want.drop("length").collect())
    files = scan.scan_scripts(spark, str(tmp_path))
    assert "binaryFile" not in files._jdf.queryExecution().toString()
    assert files.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_scan_opens_no_older_file(spark, tmp_path):
    import datetime as dt
    import os

    from conceptmine.sources import scan
    for name, at in (("old.py", 1000), ("new.py", 2000)):
        (tmp_path / name).write_text(name)
        os.utime(tmp_path / name, (at, at))
    since = dt.datetime.fromtimestamp(2000)
    assert [r.path for r in scan.scan_files(spark, str(tmp_path), "*.py", since=since).collect()] == ["new.py"]
    assert [r.path for r in scan.scan_notebooks(spark, str(tmp_path), glob="*.py", since=since).collect()] == ["new.py"]


def test_tasks_write_the_files_of_sparks_writer_themselves(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from workload import files
    keys = ["a", "", None, "x/y=%1", "{b}[c]^", "é 'q'\"#*:?\\", "\u0001\u007f", "..", "A"]
    rows = spark.createDataFrame([(k, n, f"t{n}\r\né" if n else None) for k in keys for n in range(3)], "k string, `n m` int, value string").repartition(3)
    rows.select("value", F.col("k").alias("kind"), F.col("n m").alias("n")).write.option("maxRecordsPerFile", 1).partitionBy("kind", "n").text(str(tmp_path / "want"))

    def spark_writes(*_, **__):
        raise AssertionError("each file costs Spark's writer milliseconds")
    monkeypatch.setattr(type(rows.write), "text", spark_writes)
    got = Path(files.one_file_each(rows.select("value", F.col("k").alias("kind"), F.col("n m").alias("n")), ["kind", "n"]))

    def held(root, folder):
        return sorted((str(folder(f).relative_to(root)), f.read_bytes()) for f in root.rglob("*.txt"))
    want = held(tmp_path / "want", lambda f: f.parent)
    assert held(got, lambda f: f.parents[1]) == want and len(want) == 27
    assert not list(got.glob(".*"))


def test_a_table_in_many_pieces_is_not_dealt_out(spark, tmp_path):
    from workload import files, inputs, texts
    docs = spark.range(600).selectExpr("id AS doc_id", "repeat('x', 50) AS text", "if(id % 2 = 0, 'en', 'de') AS lang", "'s' || id % 3 AS source", "50 AS n_chars")
    for name, parts, size in (("few", 1, 1 << 27), ("files", 8, 1 << 27), ("groups", 1, 1)):
        path = str(tmp_path / "a b" / name)
        writer = docs.coalesce(1).repartition(parts).write.option("parquet.block.size", size)
        writer.option("parquet.block.size.row.check.min", 10).option("parquet.block.size.row.check.max", 10).option(
            "parquet.page.size.row.check.min", 10).option("parquet.page.size.row.check.max", 10).parquet(f"{path}/documents.parquet")
        for rows in (inputs.as_stored(spark, path, "documents"), texts.notebook_files(spark, path, inputs.as_stored)):
            assert ("Exchange" in rows._jdf.queryExecution().executedPlan().toString()) == (name == "few"), name
        assert rows.count() == 600 and "Exchange" in texts.notebook_files(spark, path)._jdf.queryExecution().executedPlan().toString()
    got = sorted(tuple(r) for r in files.notebook_scan(spark, path).collect())
    assert got == [("source=s0", 200), ("source=s1", 200), ("source=s2", 200)]
