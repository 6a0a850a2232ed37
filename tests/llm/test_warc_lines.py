"""Index lines of URLs that hold line separators other than \\n."""

from kindred.llm import warc


def test_urls_with_line_separators_are_found(spark):
    rows = [(i, f"http://h{i % 7}.example.com/a{c}b{i}?q={c}", f"page {i}") for i, c in enumerate("\x85\u2028\u2029x\x0b\x0c\x1c" * 30)]
    rows += [(1000 + i, f"http://ho{c}st.example.com/{i}", "page") for i, c in enumerate("\x85\u2028\u2029x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder, parts = warc.archive(pages, block_lines=8)
    got = warc.read_captures(warc.page_keys(pages), folder, parts).collect()
    assert sorted(r["page_id"] for r in got) == sorted(i for i, _, _ in rows)
