"""All queries of the subpackage; importing the modules registers them."""

from . import alignment, decontaminate, exact_dedup, language, lm_score, near_dedup, packing, quality_rules, secrets, substring_dedup, toxicity, url_filter, whitening  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
