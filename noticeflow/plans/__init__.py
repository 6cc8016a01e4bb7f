"""Registered queries and whole plans."""

from noticeflow.plans import more, pages  # noqa: F401 - register their queries
from noticeflow.plans.queries import ORACLES, QUERIES  # noqa: F401
