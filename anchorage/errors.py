"""Error families.  An input that can't be read is never an incompatibility."""


class InputError(ValueError):
    """A resource can't give valid facts."""

    def __init__(self, message: str, path: str | None = None, line: int | None = None):
        self.path, self.line = path, line
        where = "" if path is None else f"{path}: " if line is None else f"{path}:{line}: "
        super().__init__(where + message)


class UnsupportedResource(InputError):
    """The kind of resource, or its layout, is not the one asked for."""


class Unreadable(InputError):
    """The file can't be opened."""


class ParseError(InputError):
    """The file breaks the rules of its format."""


class IdentityError(InputError):
    """Digests can't be computed or don't fit together."""


class FastaIndexError(InputError):
    """An index can't be computed."""


class FetchError(InputError):
    """Bases can't be fetched."""


class DictionaryError(InputError):
    """A dictionary can't be derived."""


class EvaluationError(InputError):
    """Facts can't be evaluated: stale, inconsistent or outside what a format allows."""
