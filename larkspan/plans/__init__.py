"""All queries of the engine: importing this package registers them."""

from larkspan.plans import catalogue, documents, grids, hierarchy, linking, naming, pricing, streams, transitions  # noqa: F401
from larkspan.plans.registry import QUERIES, SQL  # noqa: F401
