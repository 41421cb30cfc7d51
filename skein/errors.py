"""Errors of the engine."""


class SkeinError(Exception):
    """Parent of all."""


class SchemaError(SkeinError):
    """A schema that can't be frozen, or a change to a frozen one."""


class HandleError(SkeinError):
    """A handle of another schema, container or kind."""


class TransactionError(SkeinError):
    """An operation that the state of transactions doesn't allow."""


class ConstraintError(SkeinError):
    """Data that breaks the schema."""


class HookError(SkeinError):
    """A hook that writes at the wrong stage, or hooks that call each other without end."""


class QueryError(SkeinError):
    """A query that the schema doesn't allow, or an item that isn't there."""


class LogError(SkeinError):
    """A change set that can't be decoded."""


class RecoveryError(SkeinError):
    """A snapshot or log that can't be applied."""


class StorageError(SkeinError):
    """A shared folder that is missing."""
