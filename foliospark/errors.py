"""Failures by kind, each with an exit code of the command line."""

from __future__ import annotations

import json

#: kind: (exit code, may a retry help, meaning)
KINDS = {
    "usage": (2, False, "the command line is not understood"),
    "not_found": (3, False, "an input does not exist"),
    "extraction_failed": (5, False, "a document cannot be extracted"),
    "output_exists": (6, False, "an output is there already and force is off"),
    "io_error": (7, True, "reading or writing failed"),
    "no_chapters": (8, False, "a book has no chapter markers"),
    "config_error": (9, False, "a setting or a template is wrong"),
}
PARTIAL_FAILURE = 1


class EngineError(Exception):
    def __init__(self, kind: str, message: str, hint: str | None = None):
        if kind not in KINDS:
            raise ValueError(kind)
        super().__init__(message)
        self.kind, self.message, self.hint = kind, message, hint

    @property
    def code(self) -> int:
        return KINDS[self.kind][0]

    @property
    def retryable(self) -> bool:
        return KINDS[self.kind][1]

    def to_json(self) -> str:
        row = {"kind": self.kind, "message": self.message}
        if self.hint is not None:
            row["hint"] = self.hint
        return json.dumps(row, ensure_ascii=False)


class ExtractFailure(Exception):
    """A document's reason for having no Markdown; becomes its row's `reason`."""
