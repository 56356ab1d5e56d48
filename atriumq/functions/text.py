"""Text rules as column expressions: kinds of spaces by their labels, codes, names and files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that tell what a labelled space is.
CIRCULATION_WORDS = r"(?iu)\b(pasillo|pasadizo|corredor|corridor|hall|vest[ií]bulo|lobby|espera|recepci[oó]n|reception|circulaci[oó]n|atrio|foyer)\b"
ELEVATOR_WORDS = r"(?iu)\b(ascensor(es)?|elevador|elevator|lift)\b"
STAIRS_WORDS = r"(?iu)\b(escaleras?|stairs?|staircase)\b"
RAMP_WORDS = r"(?iu)\b(rampa|ramp)\b"
VOID_WORDS = r"(?iu)\b(patio|jard[ií]n|garden|ducto|shaft|vac[ií]o|void|terraza)\b"
#: Fixed value: a drawing's scale in its title block.
SCALE_TEXT = r"(?i)(?:escala|scale)\s*[:=]?\s*1\s*[:/]\s*(\d{2,4})"
#: The first bytes of the files that can be uploaded.
MAGIC = [(b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF87a", "image/gif"), (b"GIF89a", "image/gif"), (b"%PDF-", "application/pdf")]
SUFFIXES = (".pdf", ".png", ".jpg", ".jpeg", ".svg")


def is_circulation(label: Column) -> Column:
    return label.rlike(CIRCULATION_WORDS)


def vertical_kind(label: Column) -> Column:
    """elevator, stairs or ramp, the first that the label names; else null."""
    return F.when(label.rlike(ELEVATOR_WORDS), "elevator").when(label.rlike(STAIRS_WORDS), "stairs").when(label.rlike(RAMP_WORDS), "ramp")


def is_void(label: Column) -> Column:
    return label.rlike(VOID_WORDS)


def drawing_scale(label: Column, zoom: float | Column) -> Column:
    """Pixels a metre from a title block such as ``Escala 1:100``, null where the label has none."""
    n = F.regexp_extract(label, SCALE_TEXT, 1)
    return F.when(n != "", F.lit(1000 / 25.4 * 72) / n.cast("double") * zoom)


def squeezed(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def pair_key(*ends: str) -> Column:
    """Keys joined by hyphens, null where one is: ``concat_ws`` would leave it out and name another pair."""
    parts = [F.col(e).cast("string") for e in ends]
    return F.concat(parts[0], *[p for end in parts[1:] for p in (F.lit("-"), end)])


def blank(text: Column) -> Column:
    return F.coalesce(F.trim(text) == "", F.lit(True))


def code_key(code: Column) -> Column:
    """What two codes are compared by."""
    return F.lower(F.trim(code))


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))


def split_list(text: Column) -> Column:
    """Comma-separated values, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def location(token: Column) -> Column:
    """Struct of floor and node of a ``floor::node`` token."""
    parts = F.split(token, "::")
    return F.struct(F.get(parts, F.lit(0)).alias("floor"), F.get(parts, F.lit(1)).alias("node"))


def one_decimal(value: Column) -> Column:
    return F.format_string("%.1f", value)


def _head(content: Column, lower: bool = False) -> Column:
    """The first 512 bytes as text, without the white space that they begin with."""
    text = F.make_valid_utf8(F.substring(content, 1, 512).cast("string"))
    return F.regexp_replace(F.lower(text) if lower else text, r"^[ \t\n\r\x0B\f]+", "")


def media_type(content: Column) -> Column:
    """Media type by the first bytes, whatever the file is called."""
    out = F.when(F.lit(False), "")
    for magic, name in MAGIC:
        out = out.when(F.substring(content, 1, len(magic)) == F.lit(magic), name)
    head = _head(content)
    svg = head.startswith("<svg") | (head.startswith("<?xml") & F.contains(head, F.lit("<svg")))
    return out.when(svg, "image/svg+xml").otherwise("application/octet-stream")


def is_svg(content: Column) -> Column:
    """Whether the first bytes look like SVG, in either case of letters."""
    head = _head(content, lower=True)
    return head.startswith("<svg") | (head.startswith("<?xml") & F.contains(head, F.lit("<svg")))


#: How files begin that need no unwrapping, or that unwrapping may reveal.
_PLAIN = [b"\x89PNG", b"\xff\xd8", b"%PDF", b"<", b"GIF8", b"RIFF"]


def _begins(content: Column, heads: list[bytes]) -> Column:
    out = F.lit(False)
    for h in heads:
        out = out | (F.substring(content, 1, len(h)) == F.lit(h))
    return out


def unwrapped(content: Column) -> Column:
    """File content that may be wrapped in base64, with or without a ``data:`` prefix and padding.

    Unwrapped only if what comes out begins like a known file."""
    text = F.make_valid_utf8(F.substring(content, 1, 4_000_000).cast("string"))
    plain = _begins(content, _PLAIN) | _head(F.substring(content, 1, 64)).startswith("<")
    body = F.regexp_replace(F.regexp_extract(text, r"^\s*(?:data:[a-z/+.-]+;base64,)?([A-Za-z0-9+/=\r\n]+)$", 1), r"\s+", "")
    padded = F.concat(body, F.repeat(F.lit("="), F.pmod(-F.length(body), F.lit(4))))
    raw = F.when((body != "") & ~plain, F.try_to_binary(padded, F.lit("base64")))
    return F.when(raw.isNotNull() & _begins(raw, [h for h in _PLAIN if h != b"<"]), raw).otherwise(content)
