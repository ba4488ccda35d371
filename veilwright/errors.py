"""Errors that never hold a source value: a code, a reason and a JSON pointer."""

from __future__ import annotations


class PrivacyError(Exception):
    def __init__(self, code: str, reason: str | None = None, path: str | None = None, message: str = "", index: int | None = None):
        self.code, self.reason, self.path, self.index = code, reason, path, index
        super().__init__(message or ": ".join(x for x in (code, reason, path) if x))

    def __reduce__(self):
        return PrivacyError, (self.code, self.reason, self.path, str(self), self.index)

    def under(self, prefix: str) -> PrivacyError:
        return PrivacyError(self.code, self.reason, prefix + (self.path or ""), str(self), self.index)


def invalid_config(reason: str, path: str, message: str = "") -> PrivacyError:
    return PrivacyError("invalid_configuration", reason, path, message)


def invalid_finding(index: int, reason: str, field: str) -> PrivacyError:
    return PrivacyError("invalid_finding", reason, f"/findings/{index}/{field}", index=index)
