"""Errors of the library."""


class SeqlakeError(Exception):
    """The base of all."""


class Corruption(SeqlakeError):
    """Stored data that contradicts itself."""


class NotFound(SeqlakeError):
    """A backup, or something else named by the caller, that is not there."""


class InvalidArgument(SeqlakeError, ValueError):
    """An argument or option that makes no sense."""
