"""The two errors a caller can meet."""


class ValidationError(ValueError):
    """The request does not fit the table: unknown column, wrong type, too many groups."""


class ProcessingError(RuntimeError):
    """The request was sound but the table left nothing to compute on."""
