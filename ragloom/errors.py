"""Errors by what went wrong."""


class EngineError(Exception):
    """Any error of the engine."""


class ConfigError(EngineError):
    """A setting is missing, unknown or out of range."""


class DimensionMismatch(EngineError):
    """A vector's length is not the collection's."""

    def __init__(self, expected: int, actual: int):
        super().__init__(f"Vector dimension mismatch: expected {expected}, got {actual}")


class StoreError(EngineError):
    """The stored index cannot be read."""


class SourceNotFound(EngineError):
    """No source has this id, address or name."""


class EmbeddingError(EngineError):
    """A model backend answered wrongly or not at all."""


class FetchError(EngineError):
    """A page could not be fetched."""


class RobotsDenied(FetchError):
    """The host's robots.txt rules the page out."""


class ConflictError(StoreError):
    """Another writer changed what a staged part was made from."""
