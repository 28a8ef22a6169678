"""Errors of the store."""


class StoreError(Exception):
    """Base of all errors below."""


class DimensionMismatchError(StoreError, ValueError):
    def __init__(self, expected: int, got: int):
        super().__init__(f"dimension mismatch: expected {expected}, got {got}")
        self.expected, self.got = expected, got


class BadFormatError(StoreError, ValueError):
    def __init__(self, detail: str = "missing or invalid magic header"):
        super().__init__(f"bad format: {detail}")


class VersionMismatchError(StoreError, ValueError):
    def __init__(self, version: int):
        super().__init__(f"unsupported format version: {version}")
        self.version = version


class SnapshotError(StoreError, RuntimeError):
    """A snapshot that cannot be written, or read after a valid header."""
