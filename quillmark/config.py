"""Parameters of evaluation and segmentation, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class EvaluationConfig:
    alpha: float = 1.0  # weight of early steps; 0.5 to 2
    beta: float = 1.0  # weight of difficulty
    lambda_h: float = 1.0  # penalty of a hallucinated step, where penalties are on
    threshold: float = 0.6  # of one pair
    overall_threshold: float = 0.6  # of a step
    max_sentences: int = 10  # of a generation that are looked at


@dataclass(frozen=True)
class SegmentConfig:
    solution_key: str = "solution"
    min_chars: int | None = 800
    min_tokens: int | None = None
    min_sentences: int | None = None
    min_paragraphs: int | None = 3
    use_paragraphs: bool = False  # else min_paragraphs is accepted and ignored
    count_math_as_sentence: bool = False
    max_unit_chars: int = 220
    min_unit_chars: int = 60
    keep_math_block: bool = True
    compat: bool = False


@dataclass(frozen=True)
class ModelConfig:
    name: str = "stub"
    temperature: float = 0.7
    top_p: float = 0.95
    max_tokens: int = 256
    stop: str = "<<<END>>>"
    batch_size: int = 16
    devices: str = ""  # addresses of the devices of an engine, with commas; a task's own, where the cluster gives it some, come first
    resource: str = "gpu"  # what the cluster calls them
    extra: dict = field(default_factory=dict)
