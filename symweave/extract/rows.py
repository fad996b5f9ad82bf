"""What extractors give."""

from __future__ import annotations

from typing import NamedTuple

DEFINITION, REFERENCE = "definition", "reference"


class Row(NamedTuple):
    kind: str
    type: str
    name: str
    class_name: str | None
    start: int
    end: int
    body_start: int | None = None
    body_end: int | None = None
    doc: str | None = None
