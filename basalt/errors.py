"""Errors with SQLSTATE codes."""

SYNTAX, NO_TABLE, NO_COLUMN, NO_STATEMENT, UNSUPPORTED, INTERNAL = "42601", "42P01", "42703", "26000", "0A000", "XX000"
DUPLICATE_TABLE, DUPLICATE_COLUMN, BAD_TYPE, BAD_VALUE, OUT_OF_RANGE, CONFLICT, NO_PARAMETER = "42P07", "42701", "42804", "22P02", "22003", "40001", "42P02"


class SqlError(Exception):
    def __init__(self, state: str, message: str):
        super().__init__(message)
        self.state = state
