"""Errors of the codec, by kind."""


class CodecError(Exception):
    kind = "codec"


class CompatibilityError(CodecError):
    kind = "compatibility"


class CorruptionError(CodecError):
    kind = "corruption"


class InsufficientDataError(CodecError):
    kind = "insufficient data"


class InvalidArgumentError(CodecError, ValueError):
    kind = "invalid argument"


class CodecIOError(CodecError, OSError):
    kind = "io"
