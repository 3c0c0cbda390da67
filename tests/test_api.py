"""The wrapped pieces, the simple functions and the commands."""
import json

import numpy as np
import pytest

from tessera import cli, standalone, wrapped
from tessera.errors import CompatibilityError, InvalidArgumentError
from tessera.kernel import numbers as N
from tessera.kernel.config import ChunkConfig, Paging


@pytest.mark.parametrize("name", list(N.TYPES))
def test_two_pages_of_each_type(name):
    x = np.random.default_rng(1).uniform(0, 1000, 10).astype(N.TYPES[name].dtype)
    chunk = wrapped.FileCompressor().chunk_compressor(x, ChunkConfig(paging=Paging(exact=(6, 4))))
    meta, pages = chunk.write_meta(), [chunk.write_page(1), chunk.write_page(0)][::-1]
    assert len(meta) == chunk.meta_size_hint() and chunk.n_per_page() == [6, 4]
    d = wrapped.FileDecompressor(wrapped.FileCompressor().write_header()).chunk_decompressor(meta, N.TYPES[name])
    assert d.page(pages[1], 4).tolist() == x[6:].tolist()
    assert d.page(pages[0], 6).tolist() == x[:6].tolist()
    with pytest.raises(InvalidArgumentError):
        chunk.write_page(2)
    with pytest.raises(InvalidArgumentError):
        d.page_into(pages[0], 6, np.zeros(5, x.dtype))


def test_versions():
    with pytest.raises(CompatibilityError):
        wrapped.FileDecompressor(b"\x04")
    data = bytearray(standalone.compress(np.arange(3)))
    data[4] = 9
    with pytest.raises(CompatibilityError):
        standalone.decompress(bytes(data))


def test_commands(spark, tmp_path, capsys):
    spark.range(2000).selectExpr("id * 10 AS v", "id AS k").coalesce(1).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    assert cli.main(["compress", "--input", str(tmp_path / "in"), "--input-format", "parquet", "--col-name", "v", out]) == 0
    capsys.readouterr()
    assert cli.main(["decompress", "--input", f"{out}/*", "--limit", "3"]) == 0
    assert capsys.readouterr().out.split() == ["0", "10", "20"]
    assert cli.main(["inspect", "--input", f"{out}/*"]) == 0
    told = json.loads(capsys.readouterr().out)[0]
    assert told["n"] == 2000 and told["number_type"] == "i64" and told["chunks"][0]["delta"] == "consecutive"
    assert told["chunks"][0]["latent_vars"]["primary"]["name"] == "multiplier delta [x10]" or told["chunks"][0]["mode"] == "classic"
    results = tmp_path / "results.csv"
    results.write_text("input,codec,compress_dt,decompress_dt,compressed_size\nv,old,1.0,2.0,3\nv,zstd,1.0,2.0,3\n")
    assert cli.main(["bench", "--input", str(tmp_path / "in"), "--iters", "1", "--codecs", "tessera,zstd", "--results", str(results)]) == 0
    assert "<sum>" in capsys.readouterr().out
    rows = dict((line.split(",")[:2][1] + line.split(",")[0], line) for line in results.read_text().split()[1:])
    assert rows["oldv"] == "v,old,1.0,2.0,3" and rows["zstdv"] != "v,zstd,1.0,2.0,3" and {"tesserav", "tesserak"} <= rows.keys()
    assert cli.main(["decompress", "--input", f"{out}/*", "--limit", "5", "--output", str(tmp_path / "text")]) == 0
    assert [r[0] for r in spark.read.text(str(tmp_path / "text")).collect()] == ["0", "10", "20", "30", "40"]
    assert cli.main(["decompress", "--input", f"{out}/*", "--output", str(tmp_path / "raw"), "--output-format", "binary"]) == 0
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "raw").iterdir()))
    assert np.frombuffer(raw, "<i8").tolist() == list(range(0, 20000, 10))
