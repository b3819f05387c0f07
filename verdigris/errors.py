"""Errors of the library."""


class RulesError(Exception):
    """Base of all errors raised here."""


class CompileError(RulesError):
    """The authored document breaks the ruleset format."""


class RegistryError(RulesError):
    """A function is unknown, registered twice, or called with wrong arguments."""


class StoreError(RulesError):
    """A stored version is missing, present twice, or ambiguous."""


class ValidationFailed(RulesError):
    """A ruleset has validation issues; they stand in ``result``."""

    def __init__(self, result):
        super().__init__(result.to_text())
        self.result = result
