"""The registered queries by subject; importing the package registers them."""

from weirgate.plans.queries import (  # noqa: F401
    adoption,
    catalog,
    events,
    governance,
    lineage,
    runs,
    scalars,
    sources,
    streams,
    writes,
)
