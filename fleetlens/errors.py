"""Errors that users of the query languages see."""


class BadQuery(ValueError):
    """The query cannot be parsed or does not fit the entities."""


class NotFound(LookupError):
    """What a path says is its parent is not there."""


class Timeout(RuntimeError):
    """The query took longer than it was given."""
