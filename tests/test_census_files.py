"""A folder of district files with a changed file, a corrupt code, an odd count and a wrong total."""

from __future__ import annotations

import gzip
import hashlib

import pytest

from hustings.sources import censusfiles

HEADER = "State,District,Subdistt,Town/Village,Ward,Level,TRU,Name,TOT_P,No_HH"
COUNTS = ["TOT_P", "No_HH"]


@pytest.fixture
def folder(tmp_path):
    files = {
        "PCA-01001-x.csv": [HEADER, "1,1,0,0,0,DISTRICT,Total,D,300,60", "1,1,0,0,0,DISTRICT,Rural,D,300,60", "1,1,5.0,17,0, village ,rural,V,100,20", '01,001,5,18,0,Village,Rural,W,"200",40'],
        "PCA-01002-x.csv": ["No_HH, TOT_P ,Name,TRU,Level,Ward,Town/Village,Subdistt,District,State", "60,350,D,Total,DISTRICT,0,0,0,2,1", "20,100,V,Rural,VILLAGE,0,17,5,0◆,1", '-,"1,200",T,Urban,WARD,7,800001,99999,2,1'],
        "PCA-02007-x.csv.gz": [HEADER, "2,8,0,0,0,DISTRICT,Total,D,5,1", "2,8,1,1,0,VILLAGE,Rural,V,,x"],
    }
    for name, lines in files.items():
        text = "\n".join(lines) + "\n"
        (tmp_path / name).write_bytes(gzip.compress(text.encode()) if name.endswith("gz") else text.encode())
    return tmp_path


def test_digests_against_a_manifest(spark, folder):
    sha = lambda name: hashlib.sha256((folder / name).read_bytes()).hexdigest()
    manifest = spark.createDataFrame([("PCA-01001-x.csv", sha("PCA-01001-x.csv").upper()), ("PCA-01002-x.csv", "0" * 64), ("PCA-09999-x.csv", "1" * 64)], "file string, sha256 string")
    found = censusfiles.digests(spark, str(folder))
    assert {r.file: r.state for r in censusfiles.against_manifest(found, manifest).collect()} == {"PCA-01001-x.csv": "ok", "PCA-01002-x.csv": "changed", "PCA-09999-x.csv": "missing", "PCA-02007-x.csv.gz": "unlisted"}


def test_rows_of_all_files(spark, folder):
    rows = censusfiles.read(spark, str(folder), COUNTS)
    got = sorted(tuple(r) for r in censusfiles.units(rows).select("State", "District", "Subdistt", "`Town/Village`", "Ward", "TRU", "TOT_P", "No_HH", "odd", "repaired", "differs").collect())
    assert got == [
        ("01", "001", "00005", "000017", "0000", "Rural", 100, 20, 0, False, False), ("01", "001", "00005", "000018", "0000", "Rural", 200, 40, 0, False, False),
        ("01", "002", "00005", "000017", "0000", "Rural", 100, 20, 0, True, False), ("01", "002", "99999", "800001", "0007", "Urban", 1200, 0, 1, False, False), ("02", "008", "00001", "000001", "0000", "Rural", 0, 0, 1, False, True),
    ]
    gaps = {(r.file[:9], r.field): r.gap for r in censusfiles.control_gaps(rows, COUNTS).collect()}
    assert gaps == {("PCA-01001", "TOT_P"): 0, ("PCA-01001", "No_HH"): 0, ("PCA-01002", "TOT_P"): -950, ("PCA-01002", "No_HH"): 40, ("PCA-02007", "TOT_P"): 5, ("PCA-02007", "No_HH"): 1}


def test_missing_columns_and_empty_folders_raise(spark, folder, tmp_path):
    with pytest.raises(ValueError, match="no column P_SC"):
        censusfiles.read(spark, str(folder), [*COUNTS, "P_SC"])
    with pytest.raises(ValueError, match="no files"):
        censusfiles.read(spark, str(folder), COUNTS, "*.nothing")
