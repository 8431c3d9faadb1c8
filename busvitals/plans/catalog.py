"""All registered questions."""

from __future__ import annotations

from busvitals.plans import frame_questions, health_questions, model_questions, story_questions, stream_questions  # noqa: F401
from busvitals.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
