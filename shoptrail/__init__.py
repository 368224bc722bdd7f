"""Shop behaviour and ad-click analytics as PySpark DataFrame operators."""

from shoptrail.params import TaskParams
from shoptrail.session import build_session, configure

__all__ = ["TaskParams", "build_session", "configure"]
