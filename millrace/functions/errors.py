"""Errors a user of the operations sees."""


class OperationError(ValueError):
    """A step can't be applied; ``position`` and ``kind`` say which one."""

    def __init__(self, message: str, kind: str | None = None, position: int | None = None) -> None:
        self.kind, self.position, self.reason = kind, position, message
        super().__init__(f"step {position} ({kind}): {message}" if kind is not None else message)


class SourceNotFound(OperationError):
    """A source's files don't exist."""
