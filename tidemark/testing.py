"""Help for tests of comparisons: a clock that only moves when told, and assertions on results."""

from __future__ import annotations

import json
from pathlib import Path

from .operators.comparison import Result
from .plans.comparison import Diagnostic


class VirtualClock:
    """A position that goes forward only; ``horizon`` is what ``run_live`` takes."""

    def __init__(self, position: int = 0):
        if position < 0:
            raise ValueError("a position is not negative")
        self.position = position

    @property
    def horizon(self) -> int:
        return self.position

    def advance_by(self, positions: int) -> int:
        if positions < 0:
            raise ValueError("a virtual clock does not go back")
        self.position += positions
        return self.horizon

    def advance_to(self, position: int) -> int:
        return self.advance_by(position - self.position)


def assert_valid(result: Result) -> None:
    assert result.is_valid, f"the result has errors: {result.errors()}"


def assert_no_diagnostics(result: Result) -> None:
    assert not result.diagnostics, f"{len(result.diagnostics)} diagnostics: {result.diagnostics}"


def assert_diagnostic(result: Result, code: str) -> Diagnostic:
    """The first diagnostic of this code."""
    found = [d for d in result.diagnostics if d.code == code]
    assert found, f"no diagnostic {code}"
    return found[0]


def assert_row_count(result: Result, declaration: str, expected: int) -> None:
    n = result.rows(declaration).count()
    assert n == expected, f"{n} {declaration} rows, not {expected}"


def assert_snapshot(result: Result, declaration: str, path: str, update: bool = False) -> None:
    """The family's rows, sorted, against a JSON file; ``update`` (or a missing file) writes it."""
    rows = sorted(result.rows(declaration).toJSON().collect())
    text, file = json.dumps([json.loads(r) for r in rows], indent=1, sort_keys=True) + "\n", Path(path)
    if update or not file.exists():
        file.write_text(text)
    assert file.read_text() == text, f"{declaration} rows differ from {path}"
