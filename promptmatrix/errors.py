"""Errors that a user can act on; everything else is a bug."""


class MatrixError(Exception):
    """Base of all errors raised on purpose."""


class ConfigError(MatrixError):
    """The configuration or a file it names can not be used."""


class TemplateError(MatrixError):
    """A template can not be compiled or rendered."""


class ContentError(MatrixError):
    """An attachment can not be read or is of the wrong kind."""


class ScoringError(MatrixError):
    """A scorer can not grade."""


class ProviderError(MatrixError):
    """A model call failed; ``retryable`` says whether another attempt may help."""

    def __init__(self, message: str, retryable: bool = False, retry_after: float | None = None):
        super().__init__(message)
        self.retryable, self.retry_after = retryable, retry_after


class SourceError(ConfigError):
    """A paged case source misbehaved."""


class StoreError(MatrixError):
    """A run can not be stored or found."""
