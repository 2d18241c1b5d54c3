"""Hashes of input files."""

import hashlib

from foldwise.sources import panels as P


def listed(df):
    return sorted((r.name, r.size_bytes, r.sha256) for r in df.collect())


def digest(path):
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def test_files_in_cells_and_in_streams_have_the_same_digests(spark, tmp_path):
    sizes = {"a.bin": 1, "b 1%20.bin": 9, "c.bin": 10, "d.bin": 11, "e.bin": 3_000_000, "f.txt": 5}
    for name, n in sizes.items():
        (tmp_path / name).write_bytes(bytes(k * k % 251 for k in range(n)))
    want = sorted((name, n, digest(tmp_path / name)) for name, n in sizes.items() if name.endswith(".bin"))
    for whole in (-1, 10, P.WHOLE):
        assert listed(P.file_digests(spark, str(tmp_path), "*.bin", whole)) == want
    assert listed(P.file_digests(spark, str(tmp_path), "f.*")) == [("f.txt", 5, digest(tmp_path / "f.txt"))]


def test_a_file_of_more_than_two_gigabytes(spark, tmp_path):
    """Sparse, so it takes no room on disk; a cell could not hold it."""
    n = 2**31 + 5
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(n)
        f.seek(n - 3)
        f.write(b"end")
    (tmp_path / "small.bin").write_bytes(b"small")
    got = listed(P.file_digests(spark, str(tmp_path)))
    assert got == [("large.bin", n, digest(tmp_path / "large.bin")), ("small.bin", 5, hashlib.sha256(b"small").hexdigest())]
    expected = spark.createDataFrame([("large.bin", got[0][2]), ("small.bin", None), ("absent.bin", None)], "name string, sha256 string")
    checked = {r.name: r.status for r in P.check_manifest(P.file_digests(spark, str(tmp_path)), expected).collect()}
    assert checked == {"large.bin": "OK", "small.bin": "OK", "absent.bin": "MISSING"}
