import pytest
from pyspark.sql import functions as F

from cartolith.functions import columns as c


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_paths_and_languages(spark):
    paths = ["src/main.rs", "a/b/View.TSX", "net/socket.cc", "chrome/BUILD.gn", "Dockerfile", "LICENSE", "data.xyz", ".rs"]
    assert values(spark, [(p,) for p in paths], "p string", c.language(F.col("p"))) == ["Rust", "TypeScript", "C++", "GN", "Dockerfile", "Other", "Other", "Other"]
    assert values(spark, [("x/v.tsx",), ("x/V.TSX",), ("a.md",)], "p string", c.grammar(c.language(F.col("p")), F.col("p"))) == ["TSX", "TypeScript", None]
    bad = ["../secret", "tiles/../../etc/passwd", "a/..", "/etc/passwd", "a\0b", "a\\b", "C:/windows", "./manifest.json", "a//b", "", "x" * 1025]
    assert values(spark, [(p,) for p in [*bad, "a/b.c"]], "p string", c.safe_relative_path(F.col("p"))) == [None] * len(bad) + ["a/b.c"]


def test_line_counts_and_headers(spark):
    assert values(spark, [("",), ("a",), ("a\n",), ("a\nb",), ("a\nb\n",)], "t string", c.count_lines(F.col("t"))) == [0, 1, 1, 2, 2]
    assert values(spark, [("// @generated\nx",), ("\n" * 6 + "// @generated",)], "t string", c.generated_header(F.col("t"))) == [True, False]
    assert values(spark, [(bytearray(b"a\0b"),), (bytearray(b"ab"),)], "b binary", c.is_binary(F.col("b"))) == [True, False]


def test_colors(spark):
    got = values(spark, [("Rust",), ("TypeScript",), ("Brainfuck",)], "l string", c.color(F.col("l")))
    assert got[:2] == ["#dea584", "#3178c6"] and len(got[2]) == 7
    assert values(spark, [("a",)], "l string", c.fnv1a(F.col("l"))) == [0xE40C292C]


def test_text_grid_tier_and_windows(spark):
    rows = [("ab\ncdef\ng",), ("\tx",), ("",), ("x" * 400,)]
    assert [tuple(v) for v in values(spark, rows, "t string", c.text_grid(F.col("t")))] == [(4, 3), (5, 1), (1, 1), (120, 1)]
    assert values(spark, [(x,) for x in (0.5, 1.0, 5.9, 6.0, 40.0)], "x double", c.tier(F.col("x"))) == ["none", "bars", "bars", "glyphs", "glyphs"]
    got = values(spark, [(x,) for x in (0, 100, 600, 1000, 5000, 12345)], "x long", c.window_start(F.col("x")))
    assert got[:2] == [0, 0] and all(s <= line < s + 1024 for s, line in zip(got, (0, 100, 600, 1000, 5000, 12345)))
    assert values(spark, [(0,), (4095,), (4096,)], "x long", c.storage_bucket(F.col("x"))) == [0, 0, 1]


def test_imports_and_names(spark):
    raw = ['"a"', "'b'", "`c`", "<d>", " e ", '"f']
    assert values(spark, [(x,) for x in raw], "x string", c.clean_import(F.col("x"))) == ["a", "b", "c", "d", "e", '"f']
    urls = ["https://h.com/a/repo.git", "https://h.com/a/repo/", "https://h.com"]
    assert values(spark, [(x,) for x in urls], "x string", c.source_name(F.col("x"))) == ["repo", "repo", ""]


@pytest.mark.parametrize(
    ("url", "starts"),
    [
        ("https://example.com/r", None), ("https://EXAMPLE.com:443/r", None), ("http://example.com/r", "only https"), ("git://example.com/r", "only https"), ("ssh://git@example.com/r", "only https"),
        ("file:///etc/passwd", "not a valid"), ("https://other.com/r", "host other.com"), ("https://example.com.evil.com/r", "host example.com.evil.com"), ("https://u:p@example.com/r", "credentials"),
        ("https://example.com:8443/r", "only the default"), ("https://example.com/r?x=1", "query"), ("https://127.0.0.1/r", "IP-literal"), ("https://[::1]/r", "IP-literal"), ("not a url", "not a valid"),
    ],
)
def test_source_problems(spark, url, starts):
    (got,) = values(spark, [(url,)], "u string", c.source_problem(F.col("u"), ["example.com"]))
    assert got is None if starts is None else got.startswith(starts)


def test_forbidden_addresses(spark):
    bad = ["0.0.0.0", "10.1.2.3", "127.0.0.1", "100.64.0.1", "169.254.169.254", "172.16.0.1", "192.168.1.1", "198.18.0.1", "224.0.0.1", "::", "::1", "::ffff:127.0.0.1", "64:ff9b::10.0.0.1", "fd00:ec2::254", "fe80::1", "ff02::1", "2001:db8::1", "nonsense"]
    good = ["8.8.8.8", "172.32.0.1", "2606:4700::1111", "::ffff:8.8.8.8"]
    assert values(spark, [(x,) for x in bad + good], "a string", c.forbidden_address(F.col("a"))) == [True] * len(bad) + [False] * len(good)
    assert values(spark, [("a.com, ,B.org",)], "x string", c.allowlist(F.col("x"))) == [["a.com", "b.org"]]
