"""What users of the engine may catch."""


class EngineError(Exception):
    """Any refusal by the engine itself."""


class ConflictError(EngineError):
    """Another writer holds or has changed a part; try again."""
