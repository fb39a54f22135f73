"""SQL of the text rules for DuckDB, whose patterns have neither look-around nor classes beyond ASCII unless spelled out."""

from __future__ import annotations

from ..functions.text import ADVERTS, POST_ENDINGS, TOPIC_ENDINGS

SPACE = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"


def replaced(start: str, *steps: tuple[str, str] | str) -> str:
    """Nested regexp_replace, trimmed."""
    for s in steps:
        pattern, by = (s, " ") if isinstance(s, str) else s
        start = f"regexp_replace({start}, '{pattern}', '{by}', 'g')"
    return f"trim({start})"


def domains(name: str, flags: str = "") -> list[tuple[str, str]]:
    """Bare domains with a path, then those without; a sign between two of them belongs to both, hence twice."""
    plain = (f"{flags}(^|[^{WORD}]){name}([^{WORD}]|$)", r"\1 \2")
    return [(f"{flags}(^|[^{WORD}]){name}/[^{SPACE}]*", r"\1 "), plain, plain]


def topic(column: str) -> str:
    steps = [f"https?://[^{SPACE}]+", *domains(f"(?:[a-z0-9-]+\\.)+(?:{TOPIC_ENDINGS})"), r"\$[A-Za-z][A-Za-z0-9.\-]*", "@[A-Za-z0-9_]+", r"[^a-z\s]", r"\s+"]
    return replaced(f"lower({column})", *steps)


def post(column: str) -> str:
    name = f"[{WORD}][{WORD}.-]*\\.(?:{POST_ENDINGS})"
    return replaced(column, *domains(name, "(?i)"), *[f"(?i){a}" for a in ADVERTS], f"[{SPACE}]+")
