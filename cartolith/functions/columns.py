"""Column functions: all are built from Spark expressions and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartolith.functions import tables as t


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def lookup(values: dict[str, str], key: Column) -> Column:
    """A literal map; null for other keys."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


# paths


def slashes(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def parts(path: Column) -> Column:
    """The components of a path, empty ones left out; arrays order component by component."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """What follows the last dot, as written; a name's first character starts no extension."""
    return F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)


def language(path: Column) -> Column:
    return F.coalesce(lookup(t.LANGUAGE_BY_NAME, file_name(path)), lookup(t.LANGUAGE_BY_EXTENSION, F.lower(extension(path))), F.lit(t.OTHER))


def grammar(lang: Column, path: Column) -> Column:
    """The grammar of a file, null where there is none; only the exact extension tsx gives TSX."""
    key = F.when((lang == "TypeScript") & (extension(path) == "tsx"), F.lit("TSX")).otherwise(lang)
    return F.when(key.isin(t.GRAMMARS), key)


def safe_relative_path(rel: Column) -> Column:
    """rel, or null if it could leave its root."""
    bad = (
        (rel == "") | (F.length(rel) > 1024) | F.contains(rel, F.lit("\0")) | F.contains(rel, F.lit("\\")) | F.startswith(rel, F.lit("/"))
        | rel.rlike(r"^[A-Za-z]:") | F.exists(F.split(rel, "/"), lambda x: x.isin("", ".", ".."))
    )
    return F.when(~bad, rel)


# contents


def latin1(content: Column) -> Column:
    """Binary content as a string of one character a byte."""
    return F.decode(content, "ISO-8859-1")


def is_binary(content: Column) -> Column:
    return F.contains(F.substring(latin1(content), 1, t.SNIFF_BYTES), F.lit("\0"))


def count_lines(text: Column) -> Column:
    """Newlines, and one more if the last line isn't ended."""
    newlines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", F.lit(0)).when(F.endswith(text, F.lit("\n")), newlines).otherwise(newlines + 1).cast("long")


def generated_header(text: Column) -> Column:
    """text: one character a byte. A marker within the first lines and bytes."""
    head = F.substring_index(F.substring(text, 1, t.HEADER_BYTES), "\n", t.HEADER_LINES)

    def found(first: Column) -> Column:
        hit = F.lit(False)
        for m in t.GENERATED_MARKERS:
            hit = hit | F.contains(first, F.lit(m))
        return hit

    # as the only item of a list the head is cut once, not once for each marker
    return F.when(text.isNotNull(), F.exists(F.array(head), found))


def excluded_dir(path: Column) -> Column:
    """The shallowest excluded directory of a path, as a path; null if there is none."""
    dirs = F.slice(parts(path), 1, F.greatest(F.size(parts(path)) - 1, F.lit(0)))
    hits = F.filter(F.transform(dirs, lambda x, i: F.when(x.isin(t.EXCLUDED_DIRS), i + 1)), lambda i: i.isNotNull())
    return F.when(F.size(hits) > 0, F.array_join(F.slice(parts(path), F.lit(1), F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(1))), "/"))


def excluded_name(path: Column) -> Column:
    name = file_name(path)
    small = F.lit(False)
    for s in t.MINIFIED_SUFFIXES:
        small = small | F.endswith(name, F.lit(s))
    return F.when(name.isin(t.LOCKFILES), F.lit("lockfile")).when(small, F.lit("minified"))


def clean_import(raw: Column) -> Column:
    """Trimmed, and without one pair of quotes or angle brackets."""
    x = F.trim(raw)
    out = x
    for a, b in (('"', '"'), ("'", "'"), ("`", "`"), ("<", ">")):
        pair = F.startswith(x, F.lit(a)) & F.endswith(x, F.lit(b)) & (F.length(x) >= 2)
        out = F.when(pair, F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(out)
    return out


# colours


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of the UTF-8 bytes, as a long."""
    hexes = F.hex(F.encode(text, "UTF-8"))
    codes = F.when(F.length(hexes) == 0, F.array().cast("array<long>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(hexes) - 1, F.lit(1)), F.lit(2)), lambda i: F.conv(F.substring(hexes, i, F.lit(2)), 16, 10).cast("long"))
    )
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))


def color(lang: Column) -> Column:
    """A fixed colour, or one from the name's hash: hue at saturation .55 and lightness .6."""
    hue = (fnv1a(lang) % 360).cast("double") / 60
    c = F.lit((1 - abs(2 * 0.6 - 1)) * 0.55)
    x = c * (1 - F.abs(hue % 2 - 1))
    zero = F.lit(0.0)
    sector = F.floor(hue)
    channels = (((c, x, zero, zero, x, c)), ((x, c, c, x, zero, zero)), ((zero, zero, x, c, c, x)))
    m = F.lit(0.6) - c / 2

    def channel(by_sector) -> Column:
        v = by_sector[5]
        for k in range(4, -1, -1):
            v = F.when(sector == k, by_sector[k]).otherwise(v)
        return F.lpad(F.lower(F.hex(F.round((v + m) * 255).cast("long"))), 2, "0")

    return F.coalesce(lookup(t.COLORS, lang), F.concat(F.lit("#"), *[channel(ch) for ch in channels]))


# numbers


def clamp_u32(x: Column) -> Column:
    return F.least(x, F.lit(4294967295))


def storage_bucket(file_id: Column) -> Column:
    return F.shiftright(file_id, 12)


def natural_zoom(weight: Column, world: Column, density: float = 512.0, most: int = 24) -> Column:
    """The first zoom at which a cell of this area is worth drawing on its own."""
    # ceil(log4(world / (weight * density))) as a count of powers of four: exact at the powers
    z = F.lit(0)
    for k in range(most):
        z = z + (weight * (density * 4**k) < world).cast("int")
    return F.when(weight <= 0, F.lit(most)).otherwise(z)


def tile_coord(offset: Column, span: Column, z: Column) -> Column:
    n = F.pow(F.lit(2.0), z)
    t_ = F.floor(offset / F.when(span > 0, span) * n)
    return F.coalesce(F.least(F.greatest(t_, F.lit(0)), (n - 1).cast("long")), F.lit(0)).cast("long")


def ancestors(z: Column, x: Column, y: Column) -> Column:
    """A tile and all tiles above it."""
    return F.transform(F.sequence(F.lit(0), z), lambda k: F.struct((z - k).alias("z"), F.call_function("shiftright", x, k).alias("x"), F.call_function("shiftright", y, k).alias("y")))


def children(z: Column, x: Column, y: Column) -> Column:
    return F.array(*[F.struct((z + 1).alias("z"), (x * 2 + i).alias("x"), (y * 2 + j).alias("y")) for j in (0, 1) for i in (0, 1)])


def height(value: Column, most: Column, span: Column) -> Column:
    """Logarithmic height of a value; the largest reaches 0.12 of the span."""
    return 0.12 * span / F.greatest(F.log2(most + 1), F.lit(1.0)) * F.log2(F.greatest(value, F.lit(0)) + 1)


# text grid


def line_array(text: Column) -> Column:
    """The lines of a text; an ending newline begins no line, and a carriage return before one isn't part of it."""
    body = F.regexp_replace(text, r"\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(body, "\n"), lambda s: F.regexp_replace(s, r"\r\z", "")))


def columns_of(line: Column, tab: int = 4, most: int = 120) -> Column:
    """The width of a line with tab stops, at most `most`. A character takes a column at least, so no more are looked at."""
    chars = F.filter(F.split(F.substring(line, 1, most), ""), lambda c: c != "")
    width = F.aggregate(chars, F.lit(0), lambda col, ch: F.when(col >= most, col).when(ch == "\t", (F.floor(col / tab).cast("int") + 1) * tab).otherwise(col + 1))
    return F.least(width, F.lit(most))


def text_grid(text: Column) -> Column:
    lines = line_array(text)
    cols = F.coalesce(F.array_max(F.transform(lines, lambda s: columns_of(s))), F.lit(1))
    return F.struct(F.greatest(cols, F.lit(1)).alias("cols"), F.greatest(F.size(lines), F.lit(1)).alias("lines"))


def em_scale(w: Column, h: Column, cols: Column, lines: Column, advance: float = 0.6, line_height: float = 1.2, margin: float = 0.04) -> Column:
    """The size at which a grid of text fits a rectangle; font metrics and margin are parameters."""
    inner = 1 - 2 * margin
    return F.greatest(F.least(w * inner / (F.greatest(cols, F.lit(1)) * advance), h * inner / (F.greatest(lines, F.lit(1)) * line_height)), F.lit(0.0))


def tier(line_px: Column) -> Column:
    return F.when(line_px >= 6, F.lit("glyphs")).when(line_px >= 1, F.lit("bars")).otherwise(F.lit("none"))


def window_start(line: Column) -> Column:
    """The first line of the window of 1024 lines that shows a line."""
    return F.greatest(F.floor(line / 512) * 512 - 256, F.lit(0)).cast("long")


# sources and addresses


def allowlist(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def source_name(url: Column) -> Column:
    """The last non-empty segment of a URL's path, without .git."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.git$", "")


def source_problem(url: Column, hosts: list[str]) -> Column:
    """Why a source URL isn't allowed, by the first rule that fails; null if it is."""
    u = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(:[0-9]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
    piece = lambda k: F.regexp_extract(url, u, k)
    host = F.lower(piece(3))
    address = F.startswith(host, F.lit("[")) | host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    return (
        F.when(url.isNull() | ~url.rlike(u) | (host == "") | url.rlike(r"\s"), F.lit(t.NOT_A_URL))
        .when(F.lower(piece(1)) != "https", F.lit(t.NOT_HTTPS))
        .when(~piece(2).isin("", "@", ":@"), F.lit(t.HAS_CREDENTIALS))
        .when(~piece(4).isin("", ":", ":443"), F.lit(t.OTHER_PORT))
        .when((F.length(piece(6)) > 1) | (F.length(piece(7)) > 1), F.lit(t.HAS_QUERY))
        .when(address, F.lit(t.IS_ADDRESS))
        .when(~host.isin(hosts), F.concat(F.lit(t.OTHER_HOST[0]), host, F.lit(t.OTHER_HOST[1])))
    )


def ipv4_number(address: Column) -> Column:
    """An IPv4 address as a long; null for anything else."""
    number = F.aggregate(F.split(address, r"\."), F.lit(0).cast("long"), lambda a, x: F.when((a < 0) | (x.cast("int") > 255), F.lit(-1).cast("long")).otherwise(a * 256 + x.cast("int")))
    return F.when(address.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.nullif(number, F.lit(-1).cast("long")))


# The first and last address of each range that must never be contacted.
FORBIDDEN_V4 = [
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("127.0.0.0", "127.255.255.255"), ("100.64.0.0", "100.127.255.255"),
    ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"), ("192.0.0.0", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"),
    ("192.168.0.0", "192.168.255.255"), ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"), ("203.0.113.0", "203.0.113.255"),
    ("224.0.0.0", "255.255.255.255"),
]


def v4_int(address: str) -> int:
    a, b, c, d = map(int, address.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def forbidden_v4(number: Column) -> Column:
    out = F.lit(False)
    for lo, hi in FORBIDDEN_V4:
        out = out | number.between(v4_int(lo), v4_int(hi))
    return out


def ipv6_groups(address: Column) -> Column:
    """The eight 16-bit groups of an IPv6 address, a dotted end included; null if it isn't one."""
    bare = F.lower(F.regexp_replace(address, "%.*$", ""))
    dotted = r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$"
    as_groups = let(F.coalesce(ipv4_number(F.regexp_extract(bare, dotted, 1)), F.lit(0).cast("long")), lambda n: F.concat(F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(F.lit(65535)))))
    plain = F.when(bare.rlike(dotted), F.concat(F.regexp_replace(bare, dotted, ""), F.lower(as_groups))).otherwise(bare)
    given = lambda s: F.filter(F.split(s, ":"), lambda x: x != "")

    def expand(a: Column) -> Column:
        sides = F.struct(given(F.substring_index(a, "::", 1)).alias("l"), given(F.regexp_extract(a, r"::(.*)$", 1)).alias("r"))
        full = let(sides, lambda s: F.concat(s["l"], F.array_repeat(F.lit("0"), F.greatest(8 - F.size(s["l"]) - F.size(s["r"]), F.lit(0))), s["r"]))
        return F.when(F.contains(a, F.lit("::")), full).otherwise(given(a))

    ok = lambda g: (F.size(g) == 8) & F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$"))
    numbers = let(let(plain, expand), lambda g: F.when(ok(g), F.transform(g, lambda x: F.conv(x, 16, 10).cast("long"))))
    return F.when(F.contains(address, F.lit(":")), numbers)


def _forbidden_v6(g: Column) -> Column:
    at = lambda i: F.element_at(g, i + 1)
    zeros = lambda n: F.forall(F.slice(g, 1, n), lambda x: x == 0)
    masked = lambda i, m: at(i).bitwiseAND(F.lit(m))
    mapped = (zeros(5) & (at(5) == 0xFFFF)) | ((at(0) == 0x64) & (at(1) == 0xFF9B))
    return (
        F.when(zeros(7) & at(7).isin(0, 1), F.lit(True))
        .when(mapped, let(at(6) * 65536 + at(7), forbidden_v4))
        .otherwise((masked(0, 0xFE00) == 0xFC00) | (masked(0, 0xFFC0) == 0xFE80) | (masked(0, 0xFF00) == 0xFF00) | ((at(0) == 0x2001) & (at(1) == 0xDB8)))
    )


def forbidden_address(address: Column) -> Column:
    """True for addresses that must never be contacted, and for what is no address."""
    v4 = let(ipv4_number(address), forbidden_v4)
    return F.coalesce(v4, let(ipv6_groups(address), lambda g: F.when(g.isNotNull(), _forbidden_v6(g))), F.lit(True))


# a space-filling curve


def _spread(v: Column) -> Column:
    """The low 31 bits of v with a zero bit before each."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton(x: Column, y: Column) -> Column:
    """The place of (x, y) on the Z curve: their bits in turn. Tiles of one ancestor lie together."""
    return _spread(x.cast("long")).bitwiseOR(F.shiftleft(_spread(y.cast("long")), 1))


def morton_ranges(z: int, x0: int, y0: int, x1: int, y1: int, most: int = 16) -> list[tuple[int, int]]:
    """At most `most` ranges of the curve at zoom z that hold all tiles from (x0, y0) to (x1, y1), these included: squares
    that the box holds whole, or cuts where there would be too many."""
    end = (1 << z) - 1
    x0, y0, x1, y1 = max(x0, 0), max(y0, 0), min(x1, end), min(y1, end)
    if x0 > x1 or y0 > y1:
        return []
    whole, cut = [], [(0, 0, z)]  # squares of 2^k tiles a side by their corner
    while cut:
        deeper = []
        for x, y, k in cut:
            size = 1 << k
            if x > x1 or y > y1 or x + size <= x0 or y + size <= y0:
                continue
            if x >= x0 and y >= y0 and x + size - 1 <= x1 and y + size - 1 <= y1:
                whole.append((x, y, k))
            else:
                deeper.append((x, y, k))
        if len(whole) + 4 * len(deeper) > 4 * most:
            whole += deeper
            break
        cut = [(x + (i & 1) * (1 << k - 1), y + (i >> 1) * (1 << k - 1), k - 1) for x, y, k in deeper for i in range(4)]
    bits = lambda v: sum((v >> b & 1) << 2 * b for b in range(31))
    ranges: list[tuple[int, int]] = []
    for low, high in sorted((bits(x) | bits(y) << 1, (bits(x) | bits(y) << 1) + (1 << 2 * k) - 1) for x, y, k in whole):
        if ranges and low == ranges[-1][1] + 1:
            ranges[-1] = (ranges[-1][0], high)
        else:
            ranges.append((low, high))
    while len(ranges) > most:  # close the smallest gap
        k = min(range(len(ranges) - 1), key=lambda i: ranges[i + 1][0] - ranges[i][1])
        ranges[k : k + 2] = [(ranges[k][0], ranges[k + 1][1])]
    return ranges
