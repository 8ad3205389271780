"""Errors that callers can catch."""


class EmptyCacheError(Exception):
    """There are no rows to evaluate."""

    def __init__(self, message: str = "no rows to evaluate"):
        super().__init__(message)


class EmptyEvaluatorError(EmptyCacheError):
    pass


class EmptyFilterError(EmptyCacheError):
    pass


class InternalCacheError(Exception):
    pass


class InvalidLLMResponseError(Exception):
    """A judge's reply breaks its format."""
