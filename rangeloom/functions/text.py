"""Scalar functions on names, paths, URLs, versions and rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that authorise a request, by a part of their name; and schemes of cloud stores.
SECRET_QUERY = r"([?&](?:[A-Za-z0-9_.-]*(?:sig|token|credential|signature|key|secret)[A-Za-z0-9_.-]*)=)[^&\s]+"
CLOUD = {"s3": "s3", "gs": "gcs", "gcs": "gcs", "az": "azure", "azure": "azure", "abfs": "azure", "abfss": "azure", "http": "http", "https": "http", "file": "file"}
MAGIC = {"RLOOMARC": "archive", "RLOOMSEA": "sealed"}


def redact(text: Column) -> Column:
    return F.regexp_replace(text, "(?i)" + SECRET_QUERY, "$1<redacted>")


def safe_identity(url: Column) -> Column:
    """Without fragment and query, 240 characters at most."""
    return F.substring(F.substring_index(F.substring_index(url, "#", 1), "?", 1), 1, 240)


def path_is_safe(path: Column) -> Column:
    """Relative, forward slashes, no NUL, no drive, no empty, . or .. part."""
    part = r"(^|/)(\.{0,2})(/|$)"
    return F.coalesce((path != "") & ~path.contains("\0") & ~path.contains("\\") & ~path.startswith("/") & ~path.rlike(r"^[A-Za-z]:") & ~path.rlike(part), F.lit(False))


def digest_is_valid(digest: Column) -> Column:
    return F.coalesce(digest.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def scheme_kind(target: Column) -> Column:
    """Which store a target names; a bare path is a file."""
    s = F.lower(F.regexp_extract(target, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    out = F.when(s == "", "file")
    for k, v in CLOUD.items():
        out = out.when(s == k, v)
    return out.otherwise("unknown")


def container_kind(content: Column) -> Column:
    """By the first eight bytes, not by the name."""
    head = F.substring(content, 1, 8)
    out = F.when(F.octet_length(content) < 8, "plain")
    for k, v in MAGIC.items():
        out = out.when(head == F.lit(k.encode()), v)
    return out.otherwise("plain")


def rate(text: Column) -> Column:
    """Bytes a second from text like 450MB/s, 1.2g or 125e6; NULL if it is none."""
    t = F.regexp_replace(F.lower(F.trim(text)), r"(/s|ps)$", "")
    number = F.regexp_extract(t, r"^([0-9.]+(?:e[+-]?[0-9]+)?)(gb|mb|kb|g|m|k|b)?$", 1)
    unit = F.regexp_extract(t, r"^([0-9.]+(?:e[+-]?[0-9]+)?)(gb|mb|kb|g|m|k|b)?$", 2)
    scale = F.when(unit.startswith("g"), 1e9).when(unit.startswith("m"), 1e6).when(unit.startswith("k"), 1e3).otherwise(1.0)
    return F.nullif(number, F.lit("")).try_cast("double") * scale


def _two_places(x: Column) -> Column:
    """A DOUBLE of 1 or more with two decimals, rounded as printf does: by its exact value, ties to even. What Spark's
    format_string rounds is the shortest text of the number, which can lie across the middle."""
    whole = x.cast("long")
    hundredths = ((x - whole) * 2.0**52).cast("long") * 100  # in units of 2^-52, the last place of 1.0: exact
    down, rest, half = F.shiftright(hundredths, 52), hundredths.bitwiseAND(F.lit(2**52 - 1)), F.lit(2**51)
    near = down + F.when((rest > half) | ((rest == half) & (down % 2 == 1)), 1).otherwise(0)
    return F.concat((whole + F.when(near == 100, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad((near % 100).cast("string"), 2, "0"))


def size_text(nbytes: Column) -> Column:
    out = F
    for unit, name in ((1e9, "GB"), (1e6, "MB"), (1e3, "kB")):
        out = out.when(nbytes >= unit, F.concat(_two_places(nbytes / unit), F.lit(f" {name}")))
    return out.otherwise(F.concat(nbytes.cast("string"), F.lit(" B")))


def version(text: Column) -> Column:
    """Three numbers, zeros for those not given; NULL if the text does not begin with a number."""
    numbers = F.transform(F.split(F.regexp_substr(F.trim(text), F.lit("^[0-9]+([.][0-9]+)*")), "[.]"), lambda x: x.cast("int"))
    return F.slice(F.concat(numbers, F.array_repeat(F.lit(0), 3)), 1, 3)


#: What holds between a version and the one that a term names.
HOLDS = {"<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y, "==": lambda x, y: x == y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "=": lambda x, y: x == y}


def version_allowed(actual: Column, expression: Column) -> Column:
    """Whether all terms of a list with commas hold; a term without a sign asks for the version itself."""
    have = version(actual)

    def term_holds(term: Column) -> Column:
        given = F.trim(term)
        out = have == version(given)
        for sign, holds in reversed(HOLDS.items()):
            out = F.when(given.startswith(sign), holds(have, version(F.substr(given, F.lit(len(sign) + 1))))).otherwise(out)
        return F.coalesce(out, F.lit(False))

    return F.coalesce(have.isNotNull() & F.forall(F.split(expression, ","), lambda t: (F.trim(t) == "") | term_holds(t)), F.lit(False))


def nonce(i: Column) -> Column:
    """A counter as 12 bytes, big endian."""
    return F.unhex(F.lpad(F.hex(i), 24, "0"))


def cache_key(path: Column, size: Column, mtime_ns: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", path, size.cast("string"), mtime_ns.cast("string")).cast("binary"), 256), 1, 16)


def canonical_query(query: Column) -> Column:
    """Parameters sorted by name and value, joined again; a parameter without = gets one."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.array_join(F.array_sort(F.transform(pairs, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))), "&")


# Names of headers and of query parameters whose values authorise a request.
SECRET_HEADERS = ("authorization", "x-amz-security-token", "x-ms-copy-source-authorization", "x-goog-encryption-key", "cookie", "proxy-authorization")
SECRET_PARAMS = ("sig", "signature", "x-amz-signature", "x-goog-signature", "access_token")


def redact_request(text: Column) -> Column:
    """A message without the values of such headers and parameters, wherever they stand in it."""
    params = F.regexp_replace(text, rf"(?i)([?&](?:{'|'.join(SECRET_PARAMS)})=)[^& '\")\n]*", "$1REDACTED")
    return F.regexp_replace(params, rf"(?i)((?:{'|'.join(SECRET_HEADERS)}):)[^\n]*", "$1 REDACTED")


def redact_values(text: Column, values: list[str]) -> Column:
    """A message without the given secrets, those of 8 characters or more; for values known from the environment."""
    out = redact_request(text)
    for v in sorted({v for v in values if v and len(v) >= 8}, key=len, reverse=True):
        out = F.replace(out, F.lit(v), F.lit("REDACTED"))
    return out


def failure_text(message: Column) -> Column:
    """What a record keeps of an error: without credentials, 400 characters."""
    return F.substring(redact(message), 1, 400)


def stable_bytes(version_: str, seed: int, label: Column, count: Column) -> Column:
    """``count`` bytes of a hash stream over a label; the same on every platform."""
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(count / 32).cast("int") - 1), lambda i: F.sha2(F.concat_ws(":", F.lit(version_), F.lit(str(seed)), label, i.cast("string")).cast("binary"), 256))
    return F.substring(F.unhex(F.array_join(blocks, "")), 1, count.cast("int"))


def block_id(number: Column) -> Column:
    """The name of a staged block: its number, zero-padded so that all names are equally long, in base 64."""
    return F.base64(F.lpad(number.cast("string"), 8, "0").cast("binary"))


def string_to_sign(verb: Column, headers: list[Column], resource: Column) -> Column:
    """Fields that a shared key signs, a line each, in their fixed order; a missing one is an empty line."""
    return F.array_join(F.array(verb, *[F.coalesce(h.cast("string"), F.lit("")) for h in headers], resource), "\n")
