"""What can be wrong with an input, as exception types."""


class InputError(ValueError):
    """Base of all input problems."""


class InputMissing(InputError, FileNotFoundError):
    """A path does not exist."""


class InputEmpty(InputError):
    """No path holds a byte."""


class UnsupportedSuffix(InputError):
    """A file is not delimited text."""


class NoColumns(InputError):
    """Parsing found no column."""


class HeaderNotConfirmed(InputError):
    """A header row was guessed, but not surely enough to go on."""


class WrongEncoding(InputError):
    """Bytes are not of the encoding that the scan was told."""
