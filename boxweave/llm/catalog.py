"""All registered queries of this subpackage."""

from boxweave.llm import queries_cleaning, queries_dedup, queries_media, queries_models, queries_selection, queries_tokens  # noqa: F401
from boxweave.llm.registry import ORACLES, QUERIES  # noqa: F401
