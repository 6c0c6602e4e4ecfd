"""Work-session analytics as Spark DataFrame operators."""

from worktide.evidence import Evidence
from worktide.session import prepare

__all__ = ["Evidence", "prepare"]
