"""The three ways an operation can fail."""


class StoreError(Exception):
    """Base of all errors of the store."""


class StoreIOError(StoreError):
    """The file system refused an operation."""


class CorruptError(StoreError):
    """What is stored does not have the form it must have."""


class InvalidArgument(StoreError):
    """The request itself is wrong; a transaction conflict is one."""
