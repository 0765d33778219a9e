"""Errors that a caller can tell apart."""


class SequenceError(Exception):
    """Any error of this library."""


class RangeError(SequenceError, ArithmeticError):
    """A value is out of the range of its type."""


class StatementError(SequenceError, ValueError):
    """A statement, literal or type does not have the right form, or a value not the right shape."""


class InterpretError(SequenceError):
    """Values that cannot be combined, such as objects with a key in common."""


class DuplicateVariableError(SequenceError):
    """A variable of that name is there already."""


class NoSuchVariableError(SequenceError, KeyError):
    """No variable has that name."""


class InvalidArgumentError(SequenceError, ValueError):
    """An argument is outside what the call allows."""


class DuplicateCommitError(SequenceError):
    """The transaction has ended before."""


class ConflictError(SequenceError):
    """Another writer has published a version meanwhile."""


class CorruptError(SequenceError):
    """What is stored does not fit together."""
