"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much text is rejected."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches, text_rows

_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = "#*$%&|<>"
#: Phrases of site furniture in short lines, in the four languages of the corpus.
BOILERPLATE = (
    "all rights reserved|cookie|privacy policy|terms of (?:use|service)|enable javascript|click here|sign (?:in|up)|log ?in|subscribe|"
    "newsletter|share (?:this|on)|read more|back to top|lorem ipsum|alle rechte vorbehalten|datenschutz|impressum|mehr lesen|anmelden|"
    "tous droits réservés|mentions légales|lire la suite|se connecter|todos los derechos reservados|aviso legal|leer más|iniciar sesión"
)
_BOILERPLATE = re.compile(rf"\b(?:{BOILERPLATE})\b", re.IGNORECASE)
_SEPARATOR = re.compile(r"^[|»›>•·/\\–—-]+$")
_END = re.compile(r"""[.!?:;…。！？]["'”’»)\]*]*$""")


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules. Shares are of the line's words or letters."""

    min_words: int = 50
    max_repeat_percent: int = 50
    min_kept: float = 0.5
    nav_share: float = 0.2
    nav_words: int = 4
    short_line: int = 5
    boilerplate_words: int = 25
    symbol_share: float = 0.1
    upper_share: float = 0.7
    upper_letters: int = 12


def line_fault(line: str, words: list[str], rules: LineRules) -> str | None:
    """The first rule that a line with words fails, or None."""
    n = len(words)
    symbols = sum(map(line.count, _SYMBOLS))
    if n >= rules.nav_words and sum(_SEPARATOR.match(w) is not None for w in words) >= rules.nav_share * n:
        return "navigation"
    if symbols > rules.symbol_share * sum(map(len, words)):
        return "symbols"
    if n <= rules.boilerplate_words and _BOILERPLATE.search(line):
        return "boilerplate"
    if line.upper() == line or line != line.lower():
        upper = sum(map(str.isupper, line))
        letters = sum(map(str.isalpha, line))
        if letters >= rules.upper_letters and upper >= rules.upper_share * letters:
            return "capitals"
    if n <= rules.short_line and not _END.search(line.rstrip(_SPACE)):
        return "punctuation"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    if len(ids) < 1 << 21:
        window = (at[:-2] << 42) | (at[1:-1] << 21) | at[2:]
        _, inverse, count = np.unique(window, return_inverse=True, return_counts=True)
    else:
        _, inverse, count = np.unique(np.stack([at[:-2], at[1:-1], at[2:]], axis=1), axis=0, return_inverse=True, return_counts=True)
    twice = count[inverse.ravel()] > 1
    inside = np.zeros(n, dtype=bool)
    for k in range(3):
        inside[k : n - 2 + k] |= twice
    return int(inside.sum())


def judge(text: str, rules: LineRules = LineRules()) -> dict:
    """All that the rules say of a text, the kept lines among it."""
    words = text.encode("utf-8", "surrogatepass").split()
    n, kept_lines, seen, dup, removed, kept_words = len(words), [], set(), 0, 0, 0
    for line in text.split("\n"):
        own = [w.decode("utf-8", "surrogatepass") for w in line.encode("utf-8", "surrogatepass").split()]
        if not own:
            kept_lines.append(line)
            continue
        again = line in seen
        seen.add(line)
        dup += again
        if again or line_fault(line, own, rules):
            removed += 1
        else:
            kept_lines.append(line)
            kept_words += len(own)
    n_repeat = repeated_words(words)
    failed = n < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * n
    return {
        "n_words": n,
        "word_chars": len(text) - sum(map(text.count, _SPACE)),
        "n_symbols": sum(map(text.count, _SYMBOLS)),
        "n_dup_lines": dup,
        "n_repeat_words": n_repeat,
        "base_failed": failed,
        "kept": not failed and kept_words >= rules.min_kept * n,
        "removed_lines": removed,
        "kept_words": kept_words,
        "cleaned": "\n".join(kept_lines),
    }


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, removed_lines long, kept_words long"
)


def cleaned(docs: DataFrame, rules: LineRules = LineRules(), with_text: bool = True) -> DataFrame:
    """A row per document: the counts, base_failed, kept, and (with_text) the text without its failing lines.

    Narrow, one pass. Null and empty texts have no words and fail. Of equal lines the first stays. Repeated rows
    get a row each; other columns are ignored; an empty table gives an empty one."""
    names = [c.split()[0] for c in SCHEMA.split(", ")[1:]] + ["cleaned"] * with_text

    def make(ids: list, texts: list) -> dict:
        rows = [judge(t, rules) for t in texts]
        return {"doc_id": ids} | {k: [r[k] for r in rows] for k in names}

    return map_batches(text_rows(docs), make, SCHEMA + ", cleaned string" * with_text)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(documents(spark, sf_dir), with_text=False)
