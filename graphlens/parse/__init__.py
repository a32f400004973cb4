"""Parsers of the three languages; no Spark in here."""

from __future__ import annotations

import re

from . import base, dart, python, rust
from .base import Unit

LANGUAGES = {"rs": ("rust", rust.parse), "py": ("python", python.parse), "dart": ("dart", dart.parse)}
_EXT = re.compile(r"\.([A-Za-z0-9]+)$")


def extension(path: str | None) -> str:
    """The extension of a path in lower case, empty if it has none."""
    m = _EXT.search(re.split(r"[/\\]", path)[-1]) if path else None
    return m[1].lower() if m else ""


def parse_file(path: str | None, content: bytes | None) -> tuple[Unit, str]:
    """The unit of a file and its text with LF ends.

    Not UTF-8 is one error at offset 0; a path of another language gives an
    empty unit.
    """
    known = LANGUAGES.get(extension(path))
    if known is None:
        return Unit(), ""
    text = base.decode(content)
    if text is None:
        return Unit(errors=[(0, "not UTF-8")]), ""
    text = base.unify(text)
    try:
        with base.room_for(text):
            return known[1](text), text
    except RecursionError:
        return Unit(errors=[(0, "nested too deeply")]), text
