"""Errors that callers can tell apart."""


class CaseweaveError(Exception):
    """Any error of this library."""


class ConfigError(CaseweaveError):
    """Settings that can't work together, or a store opened under others."""


class NotFoundError(CaseweaveError):
    """A reference that names nothing."""


class AmbiguousReferenceError(CaseweaveError):
    """A prefix that names more than one thing."""


class ValidationError(CaseweaveError):
    """An argument that can't be meant."""


class ConflictError(CaseweaveError):
    """A name that is taken."""


class ExtractionError(CaseweaveError):
    """A file that can't be read, with the reason."""


class RerankUnavailable(CaseweaveError):
    """A reranker that can't answer now."""
