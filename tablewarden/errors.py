"""Errors raised before any job starts."""


class AuditError(ValueError):
    """A request that cannot be planned."""


class UnknownColumnError(AuditError):
    """A named column is not in the table."""


class ScratchFolderError(AuditError):
    """A shared folder is needed but none is configured."""
