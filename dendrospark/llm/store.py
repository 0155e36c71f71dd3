"""Cut points in the shared folder; see ``dendrospark.store``."""

from ..store import cut, drop, scope, shared_folder

__all__ = ["cut", "drop", "scope", "shared_folder"]
