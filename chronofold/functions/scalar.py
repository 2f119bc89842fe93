"""Column functions: log positions, hashing and routing, JSON rows, sizes, vectors, text chunks, ULIDs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_M32 = 0xFFFFFFFF


def lsn_text(lsn: Column) -> Column:
    """A position as ``hi/lo`` hexadecimal."""
    return F.concat(F.hex(F.shiftrightunsigned(lsn, 32)), F.lit("/"), F.hex(lsn.bitwiseAND(F.lit(_M32))))


def lsn_parse(text: Column) -> Column:
    part = lambda k: F.conv(F.split(text, "/")[k], 16, 10).cast("bigint")
    return F.shiftleft(part(0), 32).bitwiseOR(part(1))


def _times32(a: Column, factor: int) -> Column:
    """The low 32 bits of a product of 32-bit numbers, in 64-bit arithmetic without overflow."""
    low, high = factor & 0xFFFF, factor >> 16
    return (a * low + F.shiftleft((a * high).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_M32))


def murmur32(x: Column) -> Column:
    """The 32-bit finaliser of MurmurHash3 over a number below 2**32."""
    # Fixed values of MurmurHash3: shifts 16, 13, 16 and two multipliers.
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 16))
    x = _times32(x, 0x85EBCA6B)
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 13))
    x = _times32(x, 0xC2B2AE35)
    return x.bitwiseXOR(F.shiftrightunsigned(x, 16))


def hash_combine(a: Column, b: Column) -> Column:
    """a ^ (b + golden ratio + (a << 6) + (a >> 2)), all in 32 bits."""
    mixed = b + F.lit(0x9E3779B9) + F.shiftleft(a, 6) + F.shiftrightunsigned(a, 2)
    return a.bitwiseXOR(mixed.bitwiseAND(F.lit(_M32))).bitwiseAND(F.lit(_M32))


def shard_of(rel: Column, block: Column, shards: int, stripe: int = 2048, is_metadata: Column | None = None) -> Column:
    """The shard of a relation block; metadata lives on shard 0."""
    n = F.pmod(hash_combine(murmur32(rel), murmur32(F.floor(block / stripe).cast("bigint"))), F.lit(shards))
    return n if is_metadata is None else F.when(is_metadata, F.lit(0).cast("bigint")).otherwise(n)


def split_children(shard: Column, old: int, new: int) -> Column:
    """The shards of a count of ``new`` that a shard of ``old`` splits into."""
    return F.filter(F.sequence(F.lit(0), F.lit(new - 1)), lambda n: n % old == shard)


def size_bytes(text: Column) -> Column:
    """``512 MB`` as a number of bytes."""
    number = F.regexp_extract(text, r"^\s*([0-9.]+)", 1).cast("double")
    unit = F.lower(F.regexp_extract(text, r"([A-Za-z]*)\s*$", 1))
    powers = {"kb": 1, "mb": 2, "gb": 3, "tb": 4, "pb": 5}
    scale = reduce(lambda acc, kv: F.when(unit == kv[0], F.lit(float(1024 ** kv[1]))).otherwise(acc), powers.items(), F.lit(1.0))
    return F.floor(number * scale).cast("bigint")


def json_row(**columns: Column) -> Column:
    """A result row as a JSON object; null columns stay as null. 64-bit integers are texts, as clients of JSON numbers lose digits."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]), {"ignoreNullFields": "false"})


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def l1_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def sign_bits(a: Column) -> Column:
    """Binary quantisation: ``1`` for each positive component."""
    return F.array_join(F.transform(a, lambda x: F.when(x > 0, "1").otherwise("0")), "")


def hamming(a: Column, b: Column) -> Column:
    at = F.sequence(F.lit(1), F.length(a))
    return F.size(F.filter(at, lambda k: a.substr(k, F.lit(1)) != b.substr(k, F.lit(1))))


def text_chunks(text: Column, size: int, overlap: int) -> Column:
    """Pieces of ``size`` characters, each starting ``size - overlap`` after the one before; an empty text has none."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - overlap) / F.lit(step)).cast("int"), F.lit(1))
    parts = F.transform(F.sequence(F.lit(0), last - 1), lambda k: F.substring(text, k * step + 1, F.lit(size)))
    return F.when(F.length(text) > 0, parts).when(text.isNotNull(), F.array().cast("array<string>"))


_CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid_millis(ulid: Column) -> Column:
    """The time of a ULID in milliseconds: its first ten base-32 digits."""
    value = F.lit(0).cast("bigint")
    for k in range(1, 11):
        value = value * 32 + (F.instr(F.lit(_CROCKFORD), F.upper(F.substring(ulid, k, 1))) - 1)
    return value


def ulid_prefix(millis: Column) -> Column:
    """The ten base-32 digits of a time in milliseconds."""
    digit = lambda k: F.substring(F.lit(_CROCKFORD), F.shiftrightunsigned(millis, 5 * k).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1))
    return F.concat(*[digit(k) for k in range(9, -1, -1)])


#: Digits of a ULID and of the UUID of the same bits: (first digit, digits) of either; conv() takes up to 64 bits.
_ULID_PARTS = (((1, 2), (1, 2)), ((3, 12), (3, 15)), ((15, 12), (18, 15)))
_BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def ulid_uuid(ulid: Column) -> Column:
    """A ULID as the UUID of the same 128 bits; null for what is none."""
    digits = F.translate(F.upper(ulid), _CROCKFORD, _BASE32)
    hexed = F.lower(F.concat(*[F.lpad(F.conv(F.substring(digits, *u), 32, 16), n, "0") for u, (_, n) in _ULID_PARTS]))
    dashed = F.regexp_replace(hexed, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(F.upper(ulid).rlike(f"^[0-7][{_CROCKFORD}]{{25}}$"), dashed)


def uuid_ulid(uuid: Column) -> Column:
    """The ULID of a UUID's 128 bits."""
    hexed = F.replace(uuid, F.lit("-"), F.lit(""))
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(hexed, *h), 16, 32), n, "0") for (_, n), h in _ULID_PARTS]), _BASE32, _CROCKFORD)


def json_set(doc: Column, key: str, value: Column) -> Column:
    """A JSON object with ``key`` set to a JSON value; other keys stay as they are, in their order. Null for what is no object."""
    entries = F.map_entries(F.from_json(doc, "map<string, variant>"))
    others = F.filter(entries, lambda e: e["key"] != key)
    return F.to_json(F.map_from_entries(F.concat(others, F.array(F.struct(F.lit(key).alias("key"), F.parse_json(value).alias("value"))))))


def markdown_from_html(html: Column) -> Column:
    """Plain Markdown of simple HTML: headings, paragraphs, emphasis, code, links and list items; other tags go, scripts and styles with their content."""
    rules = [
        (r"(?is)<(script|style|head)\b[^>]*>.*?</\1\s*>", ""),
        (r"(?is)<!--.*?-->", ""),
        (r"\s+", " "),
        *[(rf"(?i) ?<h{n}\b[^>]*> ?", "\n\n" + "#" * n + " ") for n in range(1, 7)],
        (r"(?i) ?</(h[1-6]|p|div|ul|ol|table)\s*> ?", "\n\n"),
        (r"(?i) ?<li\b[^>]*> ?", "\n* "),
        (r"(?i)<br\s*/?> ?", "\n"),
        (r"(?i)</?(strong|b)\b[^>]*>", "**"),
        (r"(?i)</?(em|i)\b[^>]*>", "_"),
        (r"(?i)</?code\b[^>]*>", "`"),
        (r"""(?i)<a\b[^>]*?href=["']([^"']*)["'][^>]*>(.*?)</a\s*>""", "[$2]($1)"),
        (r"<[^>]*>", ""),
        (r"&lt;", "<"),
        (r"&gt;", ">"),
        (r"&quot;", '"'),
        (r"&#39;|&apos;", "'"),
        (r"&nbsp;", " "),
        (r"&amp;", "&"),
        (r" *\n *", "\n"),
        (r"\n{3,}", "\n\n"),
    ]
    return F.trim(F.regexp_replace(reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, html), r"^\n+|\n+$", ""))
