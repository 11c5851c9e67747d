"""Registry of extraction plans: name -> transform from pages to parsed rows.

A transform takes pages ``(page_id, url, html)`` and gives ``(page_id, title,
body_text, meta, html_length)``; its link scope goes with it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from pagemill.operators.extract import extract_fields
from pagemill.operators.precision import extract_precise


@dataclass(frozen=True)
class Extractor:
    fields: Callable[..., DataFrame]
    link_scope: str


_EXTRACTORS: dict[str, Extractor] = {
    "heuristic": Extractor(extract_fields, "cleaned"),
    "precision": Extractor(extract_precise, "raw"),
}


def extractor_names() -> tuple[str, ...]:
    return tuple(sorted(_EXTRACTORS))


def register_extractor(name: str, fields: Callable[..., DataFrame], link_scope: str = "cleaned") -> None:
    _EXTRACTORS[name] = Extractor(fields, link_scope)


def get_extractor(name: str) -> Extractor:
    if name not in _EXTRACTORS:
        raise ValueError(f"unknown extractor {name!r}; choose from {', '.join(extractor_names())}")
    return _EXTRACTORS[name]
