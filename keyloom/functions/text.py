"""Text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of a unit of time.
SECONDS = {"s": 1, "sec": 1, "''": 1, "m": 60, "min": 60, "'": 60, "h": 3600, "d": 86400, "w": 604800, "mo": 2678400, "y": 31536000}


def _map(d: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in d.items() for x in kv))


def timespan(text: Column, default: str = "s") -> Column:
    """Seconds of "1h 30m", "-2d", "5'30''" or "h:m:s"; a number without a
    unit has the default one, a unit that isn't known gives null."""
    body = F.regexp_replace(text, r"^\s*-", "")
    sign = F.when(text.rlike(r"^\s*-"), -1).otherwise(1)
    clock = F.aggregate(F.transform(F.split(body, ":"), lambda x: x.try_cast("long")), F.lit(0).cast("long"), lambda a, x: a * 60 + x)
    parts = F.transform(F.regexp_extract_all(body, F.lit(r"(\d+\s*(?:[A-Za-z]+|''|')?)"), F.lit(1)), lambda x: F.struct(F.regexp_extract(x, r"^(\d+)", 1).cast("long").alias("n"), F.regexp_extract(x, r"([A-Za-z']*)$", 1).alias("u")))
    unit = _map({**SECONDS, "": SECONDS[default]})
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x["n"] * F.element_at(unit, x["u"]))
    return sign * F.when(body.contains(":"), clock).otherwise(total)


def format_seconds(seconds: Column, extended: bool = False) -> Column:
    """``HH:MM:SS``, with hundredths where ``extended``."""
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    plain = F.concat_ws(":", two(seconds / 3600), two((seconds % 3600) / 60), two(seconds % 60))
    return F.concat(plain, F.lit("."), F.lpad(F.floor((seconds * 100) % 100).cast("string"), 2, "0")) if extended else plain


def log_of(value: Column, base: float) -> Column:
    return F.log2(value) if base == 2 else F.log10(value) if base == 10 else F.log(float(base), value)


def size_of(values: Column) -> Column:
    """The absolute values of a list."""
    return F.transform(values, F.abs)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))


def query_map(url: Column, decode: bool = False) -> Column:
    """The parameters of a URL's query as a map (the first of equal names)."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    plain = (lambda c: F.try_url_decode(c)) if decode else (lambda c: c)
    pairs = F.filter(F.split(query, "&"), lambda x: x != "")
    entries = F.transform(pairs, lambda x: F.struct(plain(F.substring_index(x, "=", 1)).alias("key"), F.when(x.contains("="), plain(F.regexp_replace(x, "^[^=]*=", ""))).alias("value")))
    return F.map_from_entries(F.filter(entries, lambda e, i: e["key"].isNotNull() & ~F.exists(F.slice(entries, 1, i), lambda o: o["key"] == e["key"])))


def query_string(params: Column) -> Column:
    """A map as a URL's query, in the order of its names."""
    entries = F.sort_array(F.map_entries(params))
    return F.array_join(F.transform(entries, lambda e: F.concat(F.url_encode(e["key"]), F.coalesce(F.concat(F.lit("="), F.url_encode(e["value"])), F.lit("")))), "&")


def with_param(url: Column, name: str, value: Column) -> Column:
    """The URL with one more parameter in its query."""
    body, tail = F.regexp_extract(url, "^([^#]*)", 1), F.regexp_extract(url, "(#.*)$", 1)
    return F.concat(body, F.when(body.contains("?"), "&").otherwise("?"), F.url_encode(F.lit(name)), F.lit("="), F.url_encode(value), tail)


def option_map(text: Column) -> Column:
    """``a=1#:b=c`` as a map of text: names and symbols without their colon."""
    pairs = F.filter(F.split(text, "#"), lambda x: F.trim(x) != "")
    bare = lambda c: F.regexp_replace(F.trim(c), "^:", "")
    value = lambda x: F.when(x.contains("="), F.regexp_replace(bare(F.regexp_replace(x, "^[^=]*=", "")), "^(['\"])(.*)\\1$", "$2")).otherwise("true")
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(bare(F.substring_index(x, "=", 1)).alias("key"), value(x).alias("value"))))


def option_text(options: Column) -> Column:
    """The inverse: a map of text, in the order of its names."""
    return F.array_join(F.transform(F.sort_array(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "#")


def pairs_map(pairs: Column) -> Column:
    """A list of two-element lists as a map; of equal names the last counts."""
    entries = F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).alias("key"), F.get(p, F.lit(1)).alias("value")))
    return F.map_from_entries(F.filter(entries, lambda e, i: e["key"].isNotNull() & ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"])))


def zipped_map(keys: Column, values: Column) -> Column:
    return F.map_from_arrays(keys, F.transform(keys, lambda _, i: F.get(values, i)))


def named(names: list[str], *values: Column) -> Column:
    """Values by position as a struct with names; missing ones are null."""
    given = [*values, *[F.lit(None)] * (len(names) - len(values))]
    return F.struct(*(v.alias(n) for n, v in zip(names, given)))


def html_tag(tag: str, body: Column | None, attributes: dict[str, Column]) -> Column:
    """An element; attributes that are null are left out."""
    safe = lambda c: F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("'"), F.lit("&#39;"))
    own = [F.when(v.isNotNull(), F.concat(F.lit(f" {k}='"), safe(v), F.lit("'"))).otherwise("") for k, v in attributes.items()]
    start = F.concat(F.lit(f"<{tag}"), *own) if own else F.lit(f"<{tag}")
    return F.concat(start, F.lit("/>")) if body is None else F.concat(start, F.lit(">"), body, F.lit(f"</{tag}>"))


def safe_name(name: Column, longest: int = 254) -> Column:
    """A file name. A long one is cut, and says its length and the start of
    its digest before its extension."""
    plain = F.translate(name, "/~", "·-")
    extension = F.regexp_extract(plain, r"(\.[^.]{2,9})$", 1)
    note = F.concat(F.lit("--"), F.length(plain).cast("string"), F.lit(f"@{longest}_"), F.left(F.md5(plain), F.lit(5)), extension)
    return F.when(F.length(plain) <= longest, plain).otherwise(F.concat(F.left(plain, F.lit(longest) - F.length(note)), note))


def snake_case(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(text, r"([A-Z]+)([A-Z][a-z])", "$1_$2"), r"([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(out, r"[\s-]+", "_"))


def camel_case(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, r"[_\s]+"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), "")


def tokens(text: Column) -> Column:
    """Words; what stands in quotes is one."""
    found = F.regexp_extract_all(text, F.lit(r"""("[^"]*"|'[^']*'|[^\s"']+)"""), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, "^[\"']|[\"']$", ""))


def without_link(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s*<(\w+)[^>]*>(.*?)</\1>\s*$", "$2")


def near(a: Column, b: Column, delta: float) -> Column:
    return F.abs(a - b) < delta


def humanize(text: Column) -> Column:
    """Words with blanks between them, the first with a capital; acronyms stay
    as they are."""
    apart = F.regexp_replace(F.regexp_replace(text, r"([A-Z]+)([A-Z][a-z])", "$1 $2"), r"([a-z0-9])([A-Z])", "$1 $2")
    words = F.filter(F.split(apart, r"[_\s]+"), lambda w: w != "")
    low = F.transform(words, lambda w: F.when(w.rlike("^[A-Z]{2,}$"), w).otherwise(F.lower(w)))
    out = F.array_join(low, " ")
    return F.concat(F.upper(F.left(out, F.lit(1))), F.substr(out, F.lit(2)))


def digest(*values: Column) -> Column:
    """A digest of values by their text, so 1 and "1" agree; nulls differ from
    empty text."""
    return F.md5(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), v.cast("string")), F.lit("-")) for v in values)))


def valid_utf8(raw: Column) -> Column:
    """Text of bytes, with a replacement character for what isn't UTF-8."""
    return F.make_valid_utf8(raw.cast("string"))


def plain_exponent(text: Column) -> Column:
    """``1e-5`` as ``1E-5``, where the whole cell is a number."""
    return F.when(text.rlike(r"^-?[0-9.]+e-?[0-9]+$"), F.upper(text)).otherwise(text)


def without_quoted_breaks(text: Column, instead: str = " ") -> Column:
    """Line breaks inside double quotes replaced: the parts between quotes are
    by turns outside and inside."""
    parts = F.split(text, '"', -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.regexp_replace(p, r"\r?\n", instead)).otherwise(p)), '"')


# Colours as ``#rrggbb`` -------------------------------------------------------


def channels(colour: Column) -> Column:
    """Red, green and blue of ``#rrggbb`` or ``#rgb``; null for other text."""
    body = F.lower(F.regexp_replace(colour, "^#", ""))
    six = F.when(body.rlike("^[0-9a-f]{3}$"), F.regexp_replace(body, "(.)", "$1$1")).when(body.rlike("^[0-9a-f]{6}$"), body)
    return F.when(six.isNotNull(), F.array(*(F.conv(F.substring(six, i, 2), 16, 10).cast("int") for i in (1, 3, 5))))


def colour_text(rgb: Column) -> Column:
    two = lambda i: F.lpad(F.lower(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.round(F.get(rgb, F.lit(i))))).cast("long"))), 2, "0")
    return F.when(rgb.isNotNull(), F.concat(F.lit("#"), two(0), two(1), two(2)))


def blended(a: Column, b: Column, share: Column | float) -> Column:
    """From ``a`` to ``b`` by that share."""
    return colour_text(F.zip_with(channels(a), channels(b), lambda x, y: x + (y - x) * share))


def lightened(colour: Column, share: Column | float) -> Column:
    return blended(colour, F.lit("#ffffff"), share)


def darkened(colour: Column, share: Column | float) -> Column:
    return blended(colour, F.lit("#000000"), share)


def grey(colour: Column) -> Column:
    """The grey of the same brightness (ITU-R BT.601 weights)."""
    rgb = channels(colour)
    level = F.get(rgb, F.lit(0)) * 0.299 + F.get(rgb, F.lit(1)) * 0.587 + F.get(rgb, F.lit(2)) * 0.114
    return colour_text(F.when(rgb.isNotNull(), F.array(level, level, level)))


def palette(value: Column, colours: list[str]) -> Column:
    """A colour for each value by its digest, so equal values agree in every
    table."""
    return F.get(F.array(*map(F.lit, colours)), F.pmod(F.crc32(value.cast("string")), F.lit(len(colours))).cast("int"))
