"""Errors raised while a plan is built, before any job runs."""


class ArgumentTypeError(TypeError):
    """An argument has the wrong type."""


class ArgumentValueError(ValueError):
    """An argument names something that is not there, or values that cannot go together."""


class ArgumentStructureError(ValueError):
    """A table lacks the shape an operator needs."""
