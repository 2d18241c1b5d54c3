"""Runs are sorted by the key they are merged by."""

from foldwise.llm import warc


def test_history_is_ordered_with_line_ends_in_urls_and_null_or_negative_ids(spark, tmp_path):
    urls = ["http://a.org/x\ny", "http://a.org/x$y", "http://a.org/x\ry", "http://a.org/x y", "http://a.org/x!y"]
    rows = [(k, u, f"<p>{k}</p>") for k, u in enumerate(urls)] + [(n, "http://b.org/", f"<p>b{n}</p>") for n in (None, -5, -1, 3, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    from pyspark.sql import functions as F

    got = warc.archive(pages, str(tmp_path / "w"), captured=F.lit("2024-01-01T00:00:00Z"))[1].collect()
    order = [(r.url_key, r.page_id is not None, r.page_id or 0) for r in sorted(got, key=lambda r: (r["range"], r["place"]))]
    assert len(order) == len(rows) and order == sorted(order)


def test_archives_are_cut_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SMALL_PAGE", 1000)
    limit, small, large = 40_000, 400, 9_000
    html = [("s%d " % k) * (small // 5) for k in range(150)] + [("l%d " % k) * (large // 5) for k in range(40)] + ["x" * 70_000]
    rows = [(k, f"http://h.org/{k}", h) for k, h in enumerate([*html, html[-1], html[0]])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    assert len(warc.records_per_archive(pages)) == 3
    monkeypatch.setattr(warc.records_per_archive, "__defaults__", ("url", "html", 1 << 30, limit))
    _, index = warc.archive(pages, str(tmp_path / "w"))
    got = index.collect()
    held: dict = {}
    for r in got:
        held.setdefault(r.archive, []).append(r.length)
    assert all(sum(n) <= limit or len(n) == 1 for n in held.values()) and max(map(len, held.values())) > 10
    assert sorted(r.page_id for r in got) == list(range(len(rows)))
    told = {r.page_id: r.refers_to for r in got}
    assert told[191] == 190 and told[192] == 0 and sum(v is not None for v in told.values()) == 2
    places = [r.url_key for r in sorted(got, key=lambda r: (r["range"], r["place"]))]
    assert places == sorted(places)
