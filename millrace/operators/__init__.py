"""Operators: functions from DataFrame to DataFrame, registered by name."""

from . import audio, clips, generate, images, marks, normalize, prompts, rules, scoring, similar, trees
from .base import REGISTRY, Operator, Pipeline, get, operator

__all__ = [
    "REGISTRY", "Operator", "Pipeline", "audio", "clips", "generate", "get", "images", "marks", "normalize", "operator", "prompts", "rules", "scoring", "similar", "trees",
]
