"""The registered queries of the library, by subject."""

from tideframe.plans import checks, constructs, governance, io, loads
from tideframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "checks", "constructs", "governance", "io", "loads"]
