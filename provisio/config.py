"""Settings, command-line arguments and the messages that users see."""

from __future__ import annotations

import argparse
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields

UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", re.IGNORECASE)


@dataclass(frozen=True)
class Settings:
    """Bounds and defaults; names in the environment are upper case."""

    min_vector_similarity: float = 0.35
    history_retention_days: int = 90
    history_max_rows: int = 300
    saved_quota: int = 100
    folder_quota: int = 25
    candidates: int = 30
    results: int = 10

    @classmethod
    def parse(cls, env: Mapping[str, str]) -> Settings:
        """Blank or malformed values give the default; whole numbers must be positive, a similarity lies in 0..1."""
        found: dict[str, float] = {}
        for f in fields(cls):
            raw = env.get(f.name.upper(), "").strip()
            try:
                value = type(f.default)(raw)
            except ValueError:
                continue
            if (0 <= value <= 1) if isinstance(f.default, float) else value > 0:
                found[f.name] = value
        return cls(**found)


def version_ids(raw: str | None) -> list[str]:
    """Version ids separated by commas, each once; a blank list or a malformed id is an error."""
    parts = [p.strip() for p in (raw or "").split(",")]
    if not any(parts):
        raise ValueError("no version ids")
    if bad := [p for p in parts if not UUID.fullmatch(p)]:
        raise ValueError(f"not a version id: {bad[0]!r}")
    return list(dict.fromkeys(p.lower() for p in parts))


def act_arguments(argv: list[str]) -> tuple[str, int, int]:
    """publisher (letters, upper-cased), year (1800 to 2200), position (positive)."""

    def letters(x: str) -> str:
        if not re.fullmatch("[A-Za-z]+", x):
            raise argparse.ArgumentTypeError("letters only")
        return x.upper()

    def within(low: int, high: int):
        def check(x: str) -> int:
            if not x.isdigit() or not low <= int(x) <= high:
                raise argparse.ArgumentTypeError(f"a whole number from {low} to {high}")
            return int(x)

        return check

    parser = argparse.ArgumentParser()
    for name, kind in (("publisher", letters), ("year", within(1800, 2200)), ("position", within(1, 10**9))):
        parser.add_argument(name, type=kind)
    found = parser.parse_args(argv)
    return found.publisher, found.year, found.position


def expression(name: str) -> str:
    """Only official expressions may be ingested."""
    from provisio.sources.metadata import EXPRESSIONS

    if name not in EXPRESSIONS:
        raise ValueError(f"not an expression: {name!r}")
    return name


class EngineError(Exception):
    """An error of a known kind: CONFIG, HTTP_ERROR, TIMEOUT or INVALID_RESPONSE."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(message or code)
        self.code = code


MESSAGES = {
    "CONFIG": "The service is not configured.",
    "HTTP_ERROR": "A service could not be reached. Please try again.",
    "TIMEOUT": "A service took too long. Please try again.",
    "INVALID_RESPONSE": "A service gave an answer that could not be used.",
}


def safe_message(error: Exception) -> str:
    """What a user may see: never an error's own text."""
    return MESSAGES.get(getattr(error, "code", ""), "Something went wrong. Please try again.")


def backoff_ms(attempt: int) -> int:
    """Wait before a further attempt, from 1."""
    return min(1000 * 2 ** (attempt - 1), 8000)


def may_retry(status: int | None) -> bool:
    """Whether a failed call may be tried again: network errors, too many requests, and server errors."""
    return status is None or status == 429 or status >= 500
