"""Errors of the filter language and of the options."""


class UnsupportedSyntaxError(ValueError):
    """Valid in the wider filter language, not evaluated here."""


class UnsupportedMissingDataError(UnsupportedSyntaxError):
    pass


class UnsupportedGenotypeValuesError(UnsupportedSyntaxError):
    pass


class UnsupportedTypeFieldError(UnsupportedSyntaxError):
    pass


class UnsupportedArraySubscriptError(UnsupportedSyntaxError):
    pass


class UnsupportedRegexError(UnsupportedSyntaxError):
    pass


class UnsupportedFileReferenceError(UnsupportedSyntaxError):
    pass


class UnsupportedFunctionsError(UnsupportedSyntaxError):
    pass


class UnsupportedHigherDimensionalFormatFieldsError(UnsupportedSyntaxError):
    pass


class UnsupportedCalculatedVariableError(UnsupportedSyntaxError):
    pass


class FilterSyntaxError(ValueError):
    """The text is not an expression."""
