"""One exception type for every failed data contract."""


class ContractViolation(ValueError):
    """Input or output breaks a stated contract; nothing was written."""
