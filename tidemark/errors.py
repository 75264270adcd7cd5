"""What the compiler raises instead of answering wrongly."""


class TidemarkError(ValueError):
    def __init__(self, operator: str, reason: str):
        super().__init__(f"{operator}: {reason}")
        self.operator, self.reason = operator, reason


class Invalid(TidemarkError):
    """The query contradicts itself or the data."""


class Unsupported(TidemarkError):
    """The query asks for what no operator here computes."""
