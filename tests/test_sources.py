import zipfile

import pytest

from punctua.sources import discover, load_raw, manifest, normalize_schema
from punctua.sources.files import CANONICAL, clean_name


def test_header_cleaning():
    assert clean_name("﻿Year ") == "year"
    assert clean_name("Arr Flights") == "arr_flights"
    assert clean_name("late-aircraft ct") == "late_aircraft_ct"


def test_unnamed_columns_and_duplicates(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Year ` int, `Unnamed: 21` int, _c2 int")
    assert normalize_schema(df).columns == ["year"]
    twice = spark.createDataFrame([(1, 2)], "`Year` int, `year ` int")
    with pytest.raises(ValueError, match="twice"):
        normalize_schema(twice)


def test_positional_names(spark):
    coded = spark.createDataFrame([tuple(range(21))], ", ".join(f"x{i} int" for i in range(21)))
    assert normalize_schema(coded).columns == CANONICAL
    short = spark.createDataFrame([tuple(range(20))], ", ".join(f"x{i} int" for i in range(20)))
    assert normalize_schema(short).columns == [f"x{i}" for i in range(20)]


def test_csv_is_preferred_and_aligned_by_name(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.csv").write_text('﻿Year ,Arr Flights,carrier,\n2024,10,"A, B",\n')
    (tmp_path / "deep" / "b c.csv").write_text("Year ,carrier,extra\n2023,NA,z\n")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        archive.writestr("a.csv", "year\n1\n")
    files = discover(spark, str(tmp_path))
    assert [f.rsplit("/", 1)[1] for f in files] == ["a.csv", "b c.csv"]
    rows = {r.year: r for r in load_raw(spark, str(tmp_path)).collect()}
    assert rows["2024"].arr_flights == "10" and rows["2024"].carrier == "A, B"
    assert rows["2023"].carrier is None and rows["2023"].extra == "z"
    kept = load_raw(spark, str(tmp_path), na_tokens=[])
    assert {r.carrier for r in kept.collect()} == {"A, B", "NA"}
    assert {r.file for r in manifest(spark, str(tmp_path)).collect()} >= {"a.csv", "a.zip"}


def test_zip_members_align_by_name(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as archive:
        archive.writestr("b.CSV", "Carrier,Year\nAA,2001\n")
        archive.writestr("a.csv", "﻿year,carrier,airport\n2000,,ATL\n")
        archive.writestr("readme.txt", "no")
    rows = sorted(load_raw(spark, str(tmp_path)).select("year", "carrier", "airport").collect())
    assert [tuple(r) for r in rows] == [("2000", None, "ATL"), ("2001", "AA", None)]


def test_source_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        discover(spark, str(tmp_path / "none"))
    (tmp_path / "x.txt").write_text("a\n")
    with pytest.raises(ValueError, match="CSV or ZIP"):
        discover(spark, str(tmp_path / "x.txt"))
    with pytest.raises(FileNotFoundError):
        discover(spark, str(tmp_path))
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as archive:
        archive.writestr("x.txt", "no")
    with pytest.raises(Exception, match="contains no CSV"):
        load_raw(spark, str(tmp_path)).collect()


def test_headers_are_read_without_the_files(spark, tmp_path, monkeypatch):
    from punctua.sources import streams
    from punctua.sources.files import header_lines

    (tmp_path / "a b.csv").write_bytes(b"\xef\xbb\xbf\n  \r\nyear,x\r\n" + b"1,2\r\n" * 400_000)
    (tmp_path / "b.csv").write_bytes(b"old,mac\r1,2\r")
    (tmp_path / "c.csv").write_bytes(b"")
    files = [str(tmp_path / n) for n in ("c.csv", "a b.csv", "b.csv")]
    assert [(r.path, r.header) for r in header_lines(spark, files)] == [
        (files[1], "year,x"), (files[2], "old,mac"), (files[0], None)]
    read = []

    class Counted:
        def __init__(self, raw):
            self.raw = raw

        def __getattr__(self, name):
            return getattr(self.raw, name)

        def read1(self, n):
            out = self.raw.read1(n)
            read.append(len(out))
            return out

    with open(tmp_path / "a b.csv", "rb") as raw:
        assert streams.first_line(Counted(raw)) == "year,x"
    assert 0 < sum(read) <= 1 << 16
    with pytest.raises(ValueError, match="nosuch"):
        streams.opened("nosuch://host/file")


def test_zip_rows_are_streamed_in_batches(spark, tmp_path, monkeypatch):
    from punctua.sources import streams

    rows = [f"{k},{k % 7},,\"a, {k}\nb\"" for k in range(25_000)]
    with zipfile.ZipFile(tmp_path / "x.zip", "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("one.csv", "\n\nid,m,,Text\n" + "\n".join(rows) + "\n\n")
        archive.writestr("two.csv", "text,id,extra\nt,-1\nu,-2,e,more\n")
        archive.writestr("empty.csv", "")
    got = load_raw(spark, str(tmp_path))
    assert sorted(got.columns) == ["extra", "id", "m", "text"]
    assert got.count() == 25_002 and got.where("id = '24999'").first().text == "a, 24999\nb"
    assert [(r.text, r.extra) for r in got.where("id < 0").orderBy("id").collect()] == [
        ("t", None), ("u", "e")]
    assert got.rdd.getNumPartitions() == 2  # one per member
    reader = streams.ZipReader([], ["id"])
    sizes = [b.num_rows for b in reader.read(streams.Part(
        [[str(tmp_path / "x.zip"), "one.csv", ["id", "m", "_c2", "text"]]]))]
    assert sizes == [10_000, 10_000, 5_000]
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as archive:
        archive.writestr("one.csv", "Id,id\n1,2\n")
    with pytest.raises(ValueError, match="twice"):
        load_raw(spark, str(tmp_path))


def test_coded_headers_in_archives_keep_their_order(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as archive:
        archive.writestr("a.csv", ",".join(f"x{i}" for i in range(21)) + "\n" + ",".join(
            str(i) for i in range(21)) + "\n")
    row = load_raw(spark, str(tmp_path)).first().asDict()
    assert [row[c] for c in CANONICAL] == [str(i) for i in range(21)]


def test_manifest_of_a_file_above_2_gb(spark, tmp_path):
    import hashlib

    size = (2 << 30) + 12_345
    with open(tmp_path / "big.csv", "wb") as out:
        out.truncate(size)  # sparse: no disk is used
    digest = hashlib.sha256()
    for _ in range(size >> 20):
        digest.update(bytes(1 << 20))
    digest.update(bytes(size & ((1 << 20) - 1)))
    row = manifest(spark, str(tmp_path)).first()
    assert (row.file, row.bytes, row.sha256) == ("big.csv", size, digest.hexdigest())
