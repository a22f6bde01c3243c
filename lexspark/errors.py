"""Errors. Messages name lengths and limits, never the text itself."""


class LexsparkError(Exception):
    pass


class InvalidRequestError(LexsparkError, ValueError):
    pass


class TokenizerError(LexsparkError, RuntimeError):
    pass
