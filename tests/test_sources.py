"""The readers themselves, over files."""

from pagemill.sources import pages as src


def test_url_lists_keep_true_line_numbers(spark, tmp_path):
    lists = {"a.txt": ["# c", "", "http://a.org/1", "http://a.org/2 | Two"], "b.txt": [f"http://b.org/{k}" for k in range(5000)]}
    for name, lines in lists.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")  # several splits of the longer list
    try:
        read = src.read_url_list(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = sorted((r.path.rsplit("/", 1)[-1], r.line_no, r.line) for r in read)
    assert got == sorted((name, k, line) for name, lines in lists.items() for k, line in enumerate(lines, 1))


def test_saved_pages_are_decoded_and_none_is_lost(spark, tmp_path):
    late = b"<!-- " + b"x" * 6000 + b" --><meta charset=latin1>\xe9"
    files = {"u.html": "<meta charset=utf-8>é".encode(), "l.html": late, "long.html": b"y" * 9000}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    rows = {r.path.rsplit("/", 1)[-1]: (r.html, r.error) for r in src.read_saved_html(spark, str(tmp_path)).collect()}
    assert rows == {"u.html": ("<meta charset=utf-8>é", None), "l.html": (late.decode("latin1"), None), "long.html": ("y" * 9000, None)}
    limited = {r.path.rsplit("/", 1)[-1]: (r.html, r.error) for r in src.read_saved_html(spark, str(tmp_path), max_bytes=8000).collect()}
    assert limited == rows | {"long.html": (None, "html too large")}
