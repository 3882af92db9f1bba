"""A run's log: what was done and what was passed over, kept until it is written."""

from __future__ import annotations

import logging
from pathlib import Path

SKIP = "[SKIP] "


class RunLog:
    """Lines in order; each also goes to the logger `hustings`."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self._logger = logging.getLogger("hustings")

    def log(self, message: str) -> None:
        self._logger.info(message)
        self.lines.append(message)

    def skip(self, message: str) -> None:
        """A step that its input didn't allow."""
        self.log(SKIP + message)

    def skipped(self) -> list[str]:
        return [line.removeprefix(SKIP) for line in self.lines if line.startswith(SKIP)]

    def write(self, path: str) -> None:
        Path(path).write_text("\n".join(self.lines), encoding="utf-8")
