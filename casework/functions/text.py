"""Text normalisation and byte decoding."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

# The characters Unicode calls White_Space.
WHITESPACE = "".join(
    chr(code)
    for code in (
        9, 10, 11, 12, 13, 32, 133, 160, 5760,
        8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202,
        8232, 8233, 8239, 8287, 12288,
    )
)

# Field-name aliases of protection-log lines -> canonical name.
FIELD_ALIASES = {
    "hr": "hresult",
    "threatid": "threat_id",
    "threat id": "threat_id",
    "threatname": "threat_name",
    "threat name": "threat_name",
    "action taken": "action",
    "statusex": "status_ex",
    "sigseq": "signature_sequence",
    "sigsha": "signature_sha",
    "fileid": "file_id",
    "scanrequest": "scan_request",
    "desiredaccess": "desired_access",
    "fileattributes": "file_attributes",
    "scanattributes": "scan_attributes",
    "accessstateflags": "access_state_flags",
    "iostatusblockfornewfile": "io_status_block_for_new_file",
    "backingfileinfo": "backing_file_info",
    "quarantine id": "quarantine_id",
    "engine version": "engine_version",
    "platform version": "platform_version",
    "security intelligence version": "security_intelligence_version",
    "path": "path",
    "file": "path",
    "filename": "path",
    "resource": "path",
    "target": "path",
}


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; plain ``lower`` is used when the text is all ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    )


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITESPACE))


def starts_blank(c: Column) -> Column:
    """True when the first character is white space."""
    return (F.char_length(c) > 0) & F.lit(WHITESPACE).contains(F.substring(c, 1, 1))


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def sanitize_name(c: Column) -> Column:
    """Lower-case slug of letters, digits and single dashes; ``artifact`` when nothing is left."""
    slug = F.btrim(F.regexp_replace(ascii_lower(strip(c)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(null_if_empty(slug), F.lit("artifact"))


def sanitize_component(c: Column, fallback: str | Column) -> Column:
    """Lower-case path component; of a run of separators only the first survives."""
    fallback = F.lit(fallback) if isinstance(fallback, str) else fallback
    dashed = F.regexp_replace(ascii_lower(strip(c)), "[^a-z0-9._-]", "-")
    single = F.regexp_replace(dashed, "([._-])[._-]+", "$1")
    return F.coalesce(null_if_empty(F.btrim(single, F.lit("-_."))), fallback)


def to_snake(c: Column) -> Column:
    return F.btrim(F.regexp_replace(ascii_lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def canonical_key(lowered: Column) -> Column:
    """Canonical name of a trimmed, lower-case field name."""
    aliases = F.create_map(*[F.lit(x) for pair in FIELD_ALIASES.items() for x in pair])
    snake = F.btrim(F.regexp_replace(lowered, "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.try_element_at(aliases, lowered), snake)


def field_key(c: Column) -> Column:
    """Canonical field name: alias table first, snake case otherwise."""
    return canonical_key(ascii_lower(strip(c)))


def field_value(c: Column) -> Column:
    return F.btrim(strip(c), F.lit('"'))


def app_from_json(c: Column) -> Column:
    """First application named by an activity's JSON id; the raw text when there is none."""
    doc = F.try_parse_json(c)
    kind = F.schema_of_variant(doc)
    first = F.when(kind.startswith("OBJECT"), F.try_variant_get(doc, "$.application[0]", "variant")).when(
        kind.startswith("ARRAY"), F.try_variant_get(doc, "$[0]", "variant")
    )
    # a JSON null is text "null" here, as for every other non-string element
    rendered = F.when(F.is_variant_null(first), F.lit("null")).otherwise(
        F.when(F.schema_of_variant(first) == "STRING", first.cast("string")).otherwise(F.to_json(first))
    )
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).otherwise(F.coalesce(rendered, c))


# ---- byte decoding -------------------------------------------------------------------------


def _even(b: Column) -> Column:
    return F.substring(b, F.lit(1), (F.length(b) - F.length(b) % 2).cast("int"))


def _hex_units(b: Column) -> Column:
    return F.regexp_extract_all(F.hex(b), F.lit("...."), F.lit(0))


def _surrogate(unit: Column, low: bool) -> Column:
    return F.substring(unit, 3, 2).between(*(("DC", "DF") if low else ("D8", "DB")))


def utf16(b: Column) -> Column:
    """UTF-16LE text; an odd tail byte is ignored and lone surrogates become U+FFFD.

    The repair path costs only rows that contain a surrogate unit at all, and does not depend on
    session settings (``decode`` alone raises on malformed input).
    """
    even = _even(b)

    def repair(units: Column) -> Column:
        padded = F.concat(F.array(F.lit("0000")), units, F.array(F.lit("0000")))
        return F.transform(
            units,
            lambda u, i: F.when(
                (_surrogate(u, False) & ~_surrogate(F.get(padded, i + 2), True))
                | (_surrogate(u, True) & ~_surrogate(F.get(padded, i), False)),
                F.lit("FDFF"),
            ).otherwise(u),
        )

    repaired = F.decode(F.unhex(F.array_join(repair(_hex_units(even)), "")), "UTF-16LE")
    # a surrogate unit has a high byte D8..DF; the lazy group keeps the search on unit boundaries
    has_surrogate = F.hex(even).rlike("^(?:.{4})*?..D[89A-F]")
    return F.when(has_surrogate, repaired).otherwise(F.decode(even, "UTF-16LE"))


def utf16z(b: Column) -> Column:
    """UTF-16LE text up to the first NUL unit."""
    return F.substring_index(utf16(b), "\x00", 1)


def utf8_lossy(b: Column) -> Column:
    return F.make_valid_utf8(b.cast("string"))


def asciiz(b: Column) -> Column:
    """8-bit text up to the first NUL byte, invalid sequences replaced."""
    nul = F.instr(F.decode(b, "ISO-8859-1"), "\x00")
    return utf8_lossy(F.when(nul > 0, F.substring(b, F.lit(1), nul - 1)).otherwise(b))


def text_encoding(content: Column) -> Column:
    """Encoding by byte-order mark, NUL density of the first 2000 bytes, then UTF-8 validity."""
    head = F.decode(F.substring(content, 1, 2000), "ISO-8859-1")
    nuls = F.length(head) - F.length(F.replace(head, F.lit("\x00"), F.lit("")))
    mark = F.hex(F.substring(content, 1, 3))
    return (
        F.when(mark == "EFBBBF", "utf-8-bom")
        .when(mark.startswith("FFFE"), "utf-16le-bom")
        .when(nuls > 100, "utf-16le")
        .when(F.is_valid_utf8(content.cast("string")), "utf-8")
        .otherwise("utf-8-lossy")
    )


def decode_as(content: Column, encoding: Column) -> Column:
    """Text of ``content`` in a detected encoding, its mark removed."""
    body = F.substring(
        content, F.when(encoding == "utf-8-bom", 4).when(encoding == "utf-16le-bom", 3).otherwise(1), F.length(content)
    )
    return (
        F.when(encoding == "utf-8", content.cast("string"))
        .when(encoding.startswith("utf-16"), utf16(body))
        .otherwise(utf8_lossy(body))
    )


def decoded_lossy(content: Column, encoding: Column) -> Column:
    """UTF-16 always counts as lossless; marked UTF-8 is lossy when its body is invalid."""
    body = F.substring(content, F.lit(4), F.length(content))
    return F.when(encoding == "utf-8-bom", ~F.is_valid_utf8(body.cast("string"))).otherwise(encoding == "utf-8-lossy")


def decode_text(content: Column) -> Column:
    """struct(text, encoding, lossy) of a file's bytes."""
    encoding = text_encoding(content)
    return F.struct(
        decode_as(content, encoding).alias("text"), encoding.alias("encoding"), decoded_lossy(content, encoding).alias("lossy")
    )
