"""The two kinds of user-facing failure."""

from __future__ import annotations


class ReportError(ValueError):
    """Stops a whole report; the message names the next step and no cell value."""


class DatasetNotFound(ReportError):
    """A dataset named by an indicator or a 5W spec is not in the catalog."""


class NotComputable(Exception):
    """One indicator, or one breakdown, cannot be computed; ``reason`` says why."""

    def __init__(self, reason: str) -> None:
        super().__init__(reason)
        self.reason = reason
