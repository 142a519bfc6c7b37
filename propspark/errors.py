class DataError(ValueError):
    """Input that an operator cannot work on (missing columns, empty result)."""


class NotFittedError(RuntimeError):
    """A model was used before it was trained."""
