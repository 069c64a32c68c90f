"""Errors by category; each message begins with its category."""


class EngineError(Exception):
    category = "Runtime"

    def __init__(self, message: str):
        super().__init__(f"{self.category} exception: {message}")


class ParserError(EngineError):
    category = "Parser"


class BinderError(EngineError):
    category = "Binder"


class CatalogError(EngineError):
    category = "Catalog"


class RuntimeFault(EngineError):
    category = "Runtime"


class ConversionError(EngineError):
    category = "Conversion"


class OverflowFault(EngineError):
    category = "Overflow"


class IOFault(EngineError):
    category = "IO"


class CopyError(EngineError):
    category = "Copy"


class ConfigurationError(EngineError):
    category = "Configuration"


class TransactionError(EngineError):
    category = "Transaction"


class UnsupportedError(EngineError):
    category = "NotImplemented"
