"""A record that fails its check is an error of the query, not a missing row."""

import pytest

from riskweave.llm import warc


@pytest.mark.parametrize("damaged", [False, True])
def test_missing_records_are_an_error(spark, tmp_path, monkeypatch, damaged):
    spark.createDataFrame([(i, f"u{i}", f"<p>page {i}</p>") for i in range(20)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    written = warc.write_archives

    def write(*args):
        manifest = written(*args)
        if damaged:
            path = manifest.first().path.removeprefix("file:")
            raw = bytearray(open(path, "rb").read())
            raw[60] ^= 0xFF
            open(path, "wb").write(raw)
        return manifest

    monkeypatch.setattr(warc, "write_archives", write)
    if damaged:
        with pytest.raises(ValueError, match="20 records were written and 19 read; 1 gaps"):
            warc.op7_warc(spark, str(tmp_path)).collect()
    else:
        assert {r.page_id for r in warc.op7_warc(spark, str(tmp_path)).collect()} == set(range(20))
