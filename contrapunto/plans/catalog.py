"""All registered queries; importing a plan module registers its queries."""

from contrapunto.plans.registry import ORACLES, QUERIES  # noqa: F401
from contrapunto.plans import rollup_queries  # noqa: F401
from contrapunto.plans import source_queries  # noqa: F401
from contrapunto.plans import projection_queries  # noqa: F401
from contrapunto.plans import resolve_queries  # noqa: F401
from contrapunto.plans import quality_queries  # noqa: F401
from contrapunto.plans import change_queries  # noqa: F401
from contrapunto.plans import document_queries  # noqa: F401
from contrapunto.plans import detail_queries  # noqa: F401
