"""Imports every query module so that the registry is complete."""

from mixlab.plans import q_mixture  # noqa: F401
from mixlab.plans import q_score  # noqa: F401
from mixlab.plans import q_sampling  # noqa: F401
from mixlab.plans import q_clean  # noqa: F401
from mixlab.plans import q_stats  # noqa: F401
from mixlab.plans import q_curves  # noqa: F401
from mixlab.plans import q_parse  # noqa: F401
from mixlab.plans import q_prompts  # noqa: F401
from mixlab.plans import q_seq  # noqa: F401
from mixlab.plans import q_enrich  # noqa: F401
from mixlab.plans import q_streams  # noqa: F401
from mixlab.plans import q_corpora  # noqa: F401
from mixlab.plans import q_sources  # noqa: F401
from mixlab.plans import q_reports  # noqa: F401
