"""Attachments: what their first bytes say, and whether that fits the declared type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scan import finding, no_findings

#: First bytes in hex, by shape, in the order they are tried.
MAGIC = (
    ("executable", ("4D5A", "7F454C46", "FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE", "CAFEBABE")),
    ("archive", ("504B", "1F8B", "377A", "526172")),
    ("pdf", ("25504446",)),
    ("image", ("89504E47", "FFD8FF", "474946")),
)
#: Parts of a declared type that fit a shape.
DECLARED = {
    "pdf": ("pdf",), "archive": ("zip", "compressed", "officedocument", "opendocument", "gzip", "tar"),
    "executable": ("executable", "octet-stream"),
}
MAX_BYTES = 10 * 1024 * 1024


def sniffed(data: Column) -> Column:
    """executable, archive, pdf, image, text or unknown, by the first eight bytes. Fewer than four are text, none (or
    null) unknown."""
    head = F.hex(F.substring(data, 1, 8))
    out = F.when(data.isNull() | (F.octet_length(data) == 0), "unknown").when(F.octet_length(data) < 4, "text")
    for shape, magics in MAGIC:
        starts = [F.startswith(head, F.lit(m)) for m in magics]
        hit = starts[0]
        for s in starts[1:]:
            hit = hit | s
        out = out.when(hit, shape)
    return out.when(head.rlike("^(?:09|0A|0D|[2-6][0-9A-F]|7[0-9A-E])+$"), "text").otherwise("unknown")


def fits(shape: Column, declared: Column) -> Column:
    kind = F.lower(declared)
    has = lambda parts: F.array_contains(F.transform(F.array(*map(F.lit, parts)), lambda p: F.contains(kind, p)), True)
    return (
        F.when(shape == "image", F.startswith(kind, F.lit("image/")))
        .when(shape == "text", F.startswith(kind, F.lit("text/")) | has(("json", "xml", "csv")))
        .when(shape == "pdf", has(DECLARED["pdf"])).when(shape == "archive", has(DECLARED["archive"]))
        .when(shape == "executable", has(DECLARED["executable"])).otherwise(True)
    )


def payload_findings(data: Column, declared: Column, max_bytes: int = MAX_BYTES, flag_archives: bool = True) -> Column:
    """Findings in their order: too large, executable, type mismatch, archive that nobody looked into."""
    shape = sniffed(data)
    mismatch = declared.isNotNull() & (shape != "unknown") & ~fits(shape, declared)
    listed = F.array(
        F.when(F.octet_length(data) > max_bytes, finding("MAL-004", "anomaly", "medium", 0.5, 1)),
        F.when(shape == "executable", finding("MAL-001", "malware", "critical", 1.0, 1)),
        F.when(mismatch, finding("MAL-002", "malware", "high", 0.4, 1)),
        F.when((shape == "archive") & F.lit(flag_archives), finding("MAL-003", "malware", "medium", 0.3, 1)),
    )
    return F.coalesce(F.filter(listed, lambda f: f.isNotNull()), no_findings())
