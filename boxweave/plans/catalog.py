"""All registered queries."""

from boxweave.plans import queries_boxes, queries_data, queries_files, queries_frames, queries_streams  # noqa: F401
from boxweave.plans.registry import ORACLES, QUERIES  # noqa: F401
