"""Errors that a query can raise before it runs."""


class QueryError(Exception):
    """Any error of a query text."""


class SyntaxProblem(QueryError):
    """The text is not a query."""

    def __init__(self, message: str, text: str = "", at: int = 0):
        line = text.count("\n", 0, at) + 1
        super().__init__(f"{message} (line {line}, column {at - text.rfind(chr(10), 0, at)})" if text else message)


class AnalysisProblem(QueryError):
    """The query is well-formed but cannot mean anything: an unknown name, a wrong type or cardinality."""
