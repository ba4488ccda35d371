"""Sensitive-data analytics on Spark: scan, protect, restore and score text at table scale."""

import importlib

__version__ = "0.1.0"

#: Name offered here: the module that has it. Modules are imported when a name is first used.
_EXPORTS = {
    "ScanConfig": "config", "TransformConfig": "config", "ScanAndTransformConfig": "config", "Strategy": "config",
    "parse_scan": "config", "parse_transform": "config", "parse_scan_and_transform": "config",
    "PrivacyError": "errors", "capabilities": "registry", "get_session": "session", "scratch_scope": "session",
    "findings": "operators.scan", "with_findings": "operators.scan", "protect": "operators.scan", "transform": "operators.scan", "audit": "operators.scan",
    "PrivacySession": "operators.tokens", "TokenProvider": "operators.tokens", "tokenize": "operators.tokens", "restore": "operators.tokens",
    "required_tokenization_items": "operators.tokens", "transform_with_provider_results": "operators.tokens", "required_items": "operators.tokens",
    "tokenize_with": "operators.tokens", "restore_with": "operators.tokens", "structured": "operators.structured",
}
__all__ = [*_EXPORTS, "__version__"]


def __getattr__(name: str):
    if name not in _EXPORTS:
        raise AttributeError(name)
    module = importlib.import_module(f"{__name__}.{_EXPORTS[name]}")
    return module if _EXPORTS[name].endswith(f".{name}") else getattr(module, name)
