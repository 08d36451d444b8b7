from . import base_checks, function_checks, count_checks, behaviour_checks, risk_checks, learn_checks, ingest_checks  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
