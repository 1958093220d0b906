"""Typed failures of the load protocol (the CLI's exit codes become types)."""


class IngestError(RuntimeError):
    """Any failed load; the published table is left as it was."""


class UnsupportedFormatError(IngestError, ValueError):
    """File name has no known suffix, or a reader was asked for a bad format."""


class UnsupportedStrategyError(IngestError, ValueError):
    """``if_exists`` is not one of skip, fail, replace, append."""


class TableExistsError(IngestError):
    """``if_exists='fail'`` and the published table is there (exit code 2)."""


class MissingColumnsError(IngestError):
    """The source lacks columns the target table requires."""


class DuplicateColumnsError(IngestError):
    """The source header names a column twice after trimming."""


class EmptyLoadError(IngestError):
    """Validation found zero staged rows."""


class MonthSpillError(IngestError):
    """Too many rows outside the expected month and failing was asked for."""


class BadDatetimeError(IngestError):
    """Text in a datetime column is no ISO datetime and failing was asked for."""


class LostPublishError(IngestError):
    """Another writer's publish replaced this one's before it could be confirmed."""


class UnsafeIdentifierError(ValueError):
    """A table/column name that is not ``[A-Za-z_][A-Za-z0-9_]*``."""


class IncompatibleTypesError(IngestError):
    """Files of one first load hold a column in types that no one type can hold."""
