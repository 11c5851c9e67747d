"""Validated parameters of a link-expansion job."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import urlsplit


@dataclass(frozen=True)
class CrawlConfig:
    start_url: str
    output_path: str
    max_pages: int = 100
    max_depth: int = 2
    allowed_path_prefix: str | None = None
    allowed_path_regex: str | None = None
    extractor: str = "heuristic"
    resume: bool = True

    def __post_init__(self) -> None:
        from pagemill.plans.extractors import extractor_names

        start = urlsplit(self.start_url)
        prefix = (self.allowed_path_prefix or "").strip()
        rules = (
            (start.scheme in ("http", "https"), "start_url needs the scheme http or https"),
            (bool(start.netloc), "start_url needs a host"),
            (bool(self.output_path.strip()), "output_path is empty"),
            (self.max_pages > 0, "max_pages must be positive"),
            (self.max_depth >= 0, "max_depth must not be negative"),
            (self.extractor in extractor_names(), f"extractor must be one of {extractor_names()}"),
            (not self.allowed_path_prefix or prefix.startswith("/"), "allowed_path_prefix must start with '/'"),
            (not (prefix and self.allowed_path_regex), "give a path prefix or a path regex, not both"),
        )
        for holds, message in rules:
            if not holds:
                raise ValueError(message)
        if self.allowed_path_regex:
            try:
                re.compile(self.allowed_path_regex)
            except re.error as problem:
                raise ValueError(f"allowed_path_regex does not compile: {problem}") from problem
        object.__setattr__(self, "allowed_path_prefix", prefix or None)

    def check_on(self, spark) -> "CrawlConfig":
        """Also compile the path regex in the engine that will run it."""
        if self.allowed_path_regex:
            try:
                spark._jvm.java.util.regex.Pattern.compile(self.allowed_path_regex)
            except Exception as problem:
                raise ValueError(f"allowed_path_regex is not a Java pattern: {self.allowed_path_regex}") from problem
        return self

    @classmethod
    def from_namespace(cls, args: object) -> "CrawlConfig":
        """Build from any object with attributes of these names; ``output`` is the path."""
        optional = {
            name: getattr(args, name)
            for name in ("max_pages", "max_depth", "allowed_path_prefix", "allowed_path_regex", "extractor", "resume")
            if getattr(args, name, None) is not None
        }
        return cls(start_url=str(args.start_url), output_path=str(args.output), **optional)
