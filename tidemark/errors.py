"""Errors of the engine. Callers match on the class."""


class EngineError(Exception):
    """Base of all."""


class StorageError(EngineError):
    """Files of the store can't be read or written."""


class HeapError(EngineError):
    """A row version can't be reached as asked."""


class TupleNotFound(HeapError):
    """No visible row has this id."""


class TupleConcurrentlyUpdated(HeapError):
    """Another transaction changed the row after this one's snapshot; retry with a new snapshot."""


class CatalogError(EngineError):
    """The catalogue contradicts itself."""


class TableExists(EngineError):
    pass


class TableNotFound(EngineError):
    pass


class InvalidArgument(EngineError):
    """A value or a call doesn't fit."""


class InvalidPredicate(EngineError):
    """A condition or a column name doesn't fit the table."""


class Corrupted(EngineError):
    """The commit log has a hole or an unreadable entry."""


class IndexError_(EngineError):
    """An index and its table disagree, or an entry is missing."""


class LockError(EngineError):
    pass


class DeadlockVictim(LockError):
    """This transaction was chosen to end a cycle of waits."""


class Unsupported(EngineError):
    """Legal elsewhere, not here."""


class IndexExists(EngineError):
    pass


class IndexNotFound(EngineError):
    pass


class ParseError(EngineError):
    """The statement isn't in the dialect."""
