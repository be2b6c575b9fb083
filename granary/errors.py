"""Errors of the engine."""

from __future__ import annotations


class MLError(ValueError):
    """Base of every error raised here."""


class DimensionMismatch(MLError):
    pass


class NotFitted(MLError):
    pass


class EmptyData(MLError):
    pass


class InvalidParameter(MLError):
    pass


class NumericalInstability(MLError):
    pass


class ConvergenceFailure(MLError):
    pass


class CsvError(MLError):
    """Base of the strict CSV source's errors."""


class TargetNotFound(CsvError):
    def __init__(self, target: str):
        super().__init__(f"Target column '{target}' not found in CSV headers")
        self.target = target


class ParseError(CsvError):
    def __init__(self, line: int, column: str, value: str):
        super().__init__(f"Line {line}, column '{column}': failed to parse '{value}' as a number")
        self.line, self.column, self.value = line, column, value


class InvalidValue(CsvError):
    def __init__(self, line: int, column: str, value: str):
        super().__init__(f"Line {line}, column '{column}': '{value}' is not a finite number")
        self.line, self.column, self.value = line, column, value


class InconsistentRow(CsvError):
    def __init__(self, line: int, expected: int, found: int):
        super().__init__(f"Line {line}: expected {expected} fields, found {found}")
        self.line, self.expected, self.found = line, expected, found


class EmptyDataset(CsvError):
    def __init__(self):
        super().__init__("Dataset has no data rows")
