"""Chromatogram files, ordered lines and large panels: SQL counterparts, damaged files, failed tasks, brute force."""

import glob
import json
import os
import random
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from assayloom.constants import IUPAC
from assayloom.operators.panel_index import panel_matches, seeds_of
from assayloom.sinks.ordered import OrderedLines, OrderedWriter, read_ordered, write_ordered
from assayloom.sinks.text import csv_field
from assayloom.source_queries import ORACLE_SQL, QUERIES
from assayloom.sources.ab1 import encode_abif, parse_abif, read_ab1, read_fields
from assayloom.sources.abif import AbifReader, AbifWriter, read_abif, write_abif

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


READ = {"bases": "ACGTN", "qualities": [1, 2, 3, 40, 50], "trace": {f"DATA{n}": list(range(-n, 0)) for n in (9, 10, 11, 12)}, "places": [3, 6, 9, 12, 15]}


def test_abif_round_trip_by_hand():
    fields = read_fields(encode_abif(**READ))
    assert fields == {"raw_seq": "ACGTN", "raw_qual": READ["qualities"], "trace": READ["trace"], "ploc": READ["places"]}
    short = read_fields(encode_abif("ac"))  # a value of four bytes at most stands in its entry
    assert short == {"raw_seq": "AC", "raw_qual": [], "trace": {}, "ploc": []}
    assert read_fields(encode_abif("AC\0\0GT\0", [0] * 7))["raw_seq"] == "AC\0\0GT\0"  # NULs count, as qualities do


def test_damaged_files():
    whole = encode_abif(**READ)
    with pytest.raises(ValueError, match="not an ABIF file"):
        parse_abif(b"ABIF")
    with pytest.raises(ValueError, match="PBAS2"):
        read_fields(whole.replace(b"PBAS", b"XBAS"))
    claims = bytearray(whole)
    struct.pack_into(">i", claims, 18, 1000)  # more entries than there are: those that are there count
    assert parse_abif(bytes(claims)) == parse_abif(whole)
    cut = whole[: -28 * 2]  # the last two entries are gone
    assert set(read_fields(cut)["trace"]) == {"DATA10", "DATA11"} and read_fields(cut)["raw_seq"] == "ACGTN"
    far = bytearray(whole)
    at = whole.index(b"PLOC")
    struct.pack_into(">i", far, at + 20, len(whole) - 2)  # values that run off the file
    with pytest.raises(struct.error):
        read_fields(bytes(far))


def test_abif_source(spark, tmp_path):
    whole = encode_abif(**READ)
    files = {"b/run.2.ab1": whole, "a/run.1.ab1": whole, "a/bad.ab1": b"ABIF", "a/empty.ab1": b"", "c.txt": whole, "a/.half.ab1": whole, "a/_x.ab1": whole}
    for name, data in files.items():
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_bytes(data)
    for read in (read_abif(spark, str(tmp_path)), read_abif(spark, f"file://{tmp_path}", partitionBytes="1")):
        got = read.orderBy("ord").collect()
        assert [(r.ord, r.filename, r.error) for r in got] == [(0, "bad.ab1", "bad.ab1 : not an ABIF file"), (1, "empty.ab1", "empty.ab1 : not an ABIF file"), (2, "run.1.ab1", None), (3, "run.2.ab1", None)]
        assert [(r.id, r.raw_len, r.mean_q, r.has_qual, r.has_trace) for r in got[2:]] == [(f"run.{i}", 5, 19.2, True, True) for i in (1, 2)]
    assert read_abif(spark, str(tmp_path), partitionBytes="1").rdd.getNumPartitions() == 4
    assert {r.filename for r in read_abif(spark, str(tmp_path), pathGlobFilter="c.*").collect()} == {"c.txt"}
    assert {r.filename: r.error is None for r in read_ab1(spark, str(tmp_path)).collect()} == {"run.1.ab1": True, "run.2.ab1": True, "bad.ab1": False}
    os.makedirs(tmp_path / "none")
    assert read_abif(spark, str(tmp_path / "none")).count() == 0
    gone = AbifReader({"path": str(tmp_path)})
    parts = gone.partitions()
    os.remove(tmp_path / "b/run.2.ab1")
    rows = [r for p in parts for b in gone.read(p) for r in b.to_pylist()]
    assert len(rows) == 4 and "run.2.ab1" in rows[3]["error"]


def test_failed_writes_leave_nothing(spark, tmp_path):
    rows = [(f"p/{i}.ab1", "ACGT" if i else None, [1, 2, 3, 4], None, [1, 2, 3, 4]) for i in range(6)]
    frame = spark.createDataFrame(rows, "filename string, raw_seq string, raw_qual array<int>, trace map<string,array<int>>, ploc array<int>")
    with pytest.raises(Exception, match="None|encode"):
        write_abif(frame, str(tmp_path / "x"))
    assert not glob.glob(f"{tmp_path}/x/**/*.ab1", recursive=True)
    write_abif(frame.where("raw_seq is not null"), str(tmp_path / "x"))
    write_abif(frame.where("filename = 'p/3.ab1'"), str(tmp_path / "x"))  # again, by its name
    assert [r.filename for r in read_abif(spark, str(tmp_path / "x")).orderBy("ord").collect()] == [f"{i}.ab1" for i in range(1, 6)]
    writer = AbifWriter({"path": str(tmp_path / "y")})
    done = writer.write(iter(frame.where("raw_seq is not null").collect()))
    writer.abort([done, None])
    assert not glob.glob(f"{tmp_path}/y/**/*.ab1", recursive=True)


def test_ordered_lines(spark, tmp_path):
    path = str(tmp_path / "t")
    table = spark.range(50_000).select((F.col("id") * 7919 % 50_000).alias("k")).withColumn("line", F.concat(F.lit("é,"), F.col("k").cast("string")))
    write_ordered(table.repartition(5), ["k"], path, "\r\n")
    got = read_ordered(spark, path).orderBy("number").collect()
    assert [(r.number, r.line) for r in got] == [(i, f"é,{i}") for i in range(50_000)]
    manifest = json.load(open(f"{path}/_manifest.json"))
    data = b"".join(open(f"{path}/{p['file']}", "rb").read() for p in manifest["parts"])
    assert len(data) == manifest["bytes"] and data.decode().split("\r\n")[:-1] == [r.line for r in got]
    write_ordered(table.where("k < 3"), ["k"], path)  # replaces the table and its parts
    assert [r.line for r in read_ordered(spark, path).orderBy("number").collect()] == ["é,0", "é,1", "é,2"]
    assert len(glob.glob(f"{path}/part-*")) == len(json.load(open(f"{path}/_manifest.json"))["parts"])
    write_ordered(table.where("k < 0"), ["k"], path)
    assert read_ordered(spark, path).count() == 0


def test_a_failed_task_leaves_no_part(spark, tmp_path):
    path = str(tmp_path / "t")
    write_ordered(spark.createDataFrame([(1, "old")], "k int, line string"), ["k"], path)
    bad = spark.range(4000).select(F.col("id").alias("k"), F.when(F.col("id") != 3500, F.lit("new")).alias("line"))
    with pytest.raises(Exception, match="NoneType|unsupported"):
        write_ordered(bad, ["k"], path)
    assert [r.line for r in read_ordered(spark, path).collect()] == ["old"] and len(glob.glob(f"{path}/part-*")) == 1
    assert OrderedLines.name() == "ordered_lines" and OrderedWriter({"path": path}).end == "\n"


def test_csv_booleans(spark):
    row = spark.createDataFrame([(True, False, None, 'a "b", c', "d\ne")], "a boolean, b boolean, c boolean, d string, e string")
    assert list(row.select(*[csv_field(F.col(c)) for c in row.columns]).first()) == ["True", "False", "", '"a ""b"", c"', '"d\ne"']


def test_large_panel_against_all_pairs(spark):
    rnd = random.Random(5)
    base = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    panel = []
    for i in range(120):
        p = base(rnd.choice((18, 21, 24)))
        for _ in range(rnd.randrange(4)):
            k = rnd.randrange(len(p))
            p = p[:k] + rnd.choice(list(IUPAC)) + p[k + 1 :]
        panel.append((f"p{i}", f"g{i % 2}", ("a", "b")[i % 2], rnd.choice((0, 3, -2)), p))
    panel += [("short", "g0", "a", 0, "AN"), ("wide", "g1", "b", 0, "N" * 12), ("none", "g0", "a", 0, None), ("odd", "g0", "a", 0, "XACGTACGTACG"), ("p0", "g0", "a", 9, panel[0][4])]
    reads = []
    for i in range(200):
        _, _, site, offset, p = panel[rnd.randrange(120)]
        seen = "".join(rnd.choice(IUPAC[c]) if rnd.random() > 0.06 else rnd.choice("ACGTN") for c in p)
        reads.append((i, base(6 + offset) + seen + base(rnd.randrange(12)), {site: 6, "c": 1, "b" if site == "a" else "a": rnd.choice((-1, 4, None))}))
    reads += [(200, None, {"a": 0}), (201, "ACGT", None), (202, "", {"a": 0}), (0, *reads[0][1:])]
    radius, want = 3, {}
    for i, seq, sites in reads:
        near = {}
        for pid, grp, site, offset, p in panel:
            pos = (sites or {}).get(site)
            if p is None or seq is None or pos is None or pos < 0 or pos + offset < 0 or pos + offset + len(p) > len(seq):
                continue
            mm = sum(b not in IUPAC.get(c, "") or b not in "ACGT" for b, c in zip(seq[pos + offset :], p))
            if mm <= radius:
                near.setdefault(grp, {}).setdefault(mm, set()).add(pid)
        for grp, levels in near.items():
            (m, names), (m2, names2) = [*sorted(levels.items()), (None, None)][:2]
            want[i, grp] = (m, sorted(names), m2, names2 and sorted(names2))
    frame = spark.createDataFrame(panel, "pid string, grp string, site string, offset int, pattern string")
    got = panel_matches(spark.createDataFrame(reads, "id int, seq string, sites map<string,int>"), frame, radius, ["id"])
    assert {(r.id, r.grp): (r.mm, r.names, r.next_mm, r.next_names) for r in got.collect()} == want and len(want) > 150
    assert seeds_of(frame, radius).groupBy("pid", "offset", "low").count().agg(F.max("count")).first()[0] <= 64
