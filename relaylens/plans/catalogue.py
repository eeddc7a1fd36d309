"""All named queries: importing the modules fills the registry."""

from relaylens.plans import governance, metrics, mirroring, state  # noqa: F401
from relaylens.plans.registry import ORACLES, QUERIES  # noqa: F401
