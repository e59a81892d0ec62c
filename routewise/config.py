"""Constants of the routing study.

Everything under "Fixed values" must equal the published study for results
to match; it is stated here once, in natural order, and imported everywhere
else.  Tunables (thresholds, grids) are plain dataclass fields.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must match the published study)
# ---------------------------------------------------------------------------

#: The three candidate models, by label 1, 2, 3.
MODELS = ("t5_base", "t5_large", "t5_xl")
MODEL_SHORT = ("base", "large", "xl")

#: The nine response-quality metrics.
METRICS = ("bart", "rouge1", "rouge2", "rougeL", "rougeLsum", "bleu", "bert", "bleurt", "logprobs")

#: Metrics normalized on a log scale (the rest by plain min-max).
LOG_METRICS = ("bart", "bleu", "bert", "bleurt", "logprobs")

#: Query category number -> name.
CATEGORY_NAMES = {
    1: "Factual Question Answering",
    2: "Open-ended/Opinion-based",
    3: "Creative Text Generation",
    4: "Instruction Following",
    5: "Mathematics/Problem Solving",
    6: "Recommendation Systems",
    7: "Coding/Programming",
    8: "Summarization/Paraphrasing",
    9: "Translation",
    10: "Reasoning/Logic",
    11: "Dialogue/Conversational",
    12: "Comparative/Analytical",
    13: "Miscellaneous/Other",
    14: "General Advice/Personal",
}

#: Category name -> complexity weight; unknown categories get DEFAULT_CATEGORY_WEIGHT.
CATEGORY_WEIGHTS = {
    "Mathematics/Problem Solving": 1.0,
    "Coding/Programming": 0.9,
    "Reasoning/Logic": 0.85,
    "Summarization/Paraphrasing": 0.75,
    "Comparative/Analytical": 0.7,
    "Creative Text Generation": 0.6,
    "Open-ended/Opinion-based": 0.5,
    "Recommendation Systems": 0.45,
    "General Advice/Personal": 0.4,
    "Dialogue/Conversational": 0.35,
    "Factual Question Answering": 0.3,
    "Instruction Following": 0.25,
    "Translation": 0.2,
    "Miscellaneous/Other": 0.15,
}
DEFAULT_CATEGORY_WEIGHT = 0.03

#: Characters counted by query_special_tokens_count (33 characters).
SPECIAL_TOKENS = [":", ";", "=", "+", "-", "_", "/", ".", "'", '"', "´", "`", ",", "<", ">", "[", "]",
                  "{", "}", "(", ")", "?", "!", "*", "&", "$", "#", "@", "%", "^", "~", "|", "\\"]

#: Complexity keywords (39 words, each a single word).
KEYWORDS = [
    "analyze", "synthesize", "interpret", "evaluate", "justify", "compare",
    "optimize", "hypothesize", "formulate", "simulate", "derive", "describe",
    "validate", "correlate", "quantify", "investigate", "predict", "forecast",
    "prove", "assess", "criticize", "argue", "solve", "reconstruct", "theorize",
    "explore", "elaborate", "deduce", "refute", "conceptualize", "identify", "outline",
    "rationalize", "articulate", "summarize", "innovate", "extrapolate", "explain", "clarify",
]

#: Complexity score weights.
FEATURE_WEIGHTS = {
    "category": 2.5,
    "length": 1.0,
    "unique": 0.4,
    "readability": 1.2,
    "special_tokens": 0.9,
    "keywords": 1.5,
    "url_presence": 1.0,
}

#: Readability is capped at this value before min-max scaling.
READABILITY_CAP = 20.0

#: Compute units per routed model label 1, 2, 3.
COMPUTE_UNITS = (1.0, 3.12, 12.0)

#: Trash predicate thresholds (strict comparisons).
TRASH_MAX_REDUNDANCY = 0.85
TRASH_MAX_WORDS = 100
TRASH_MAX_RUNTIME_MS = 1000.0

#: Responses sampled per model and query.
RESPONSES_PER_MODEL = 10

#: Discrepancy thresholds of the published label sweep.
DISCREPANCY_THRESHOLDS = (0.0, -0.005, -0.01, -0.015, -0.02, -0.025, -0.03)

#: Confidence thresholds of the published routing sweep.
PROBABILITY_THRESHOLDS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)

#: Quantile grids of the length / complexity baseline routers (the third value is unused).
QUANTILE_SETTINGS = ((0.20, 0.40, 0.60), (0.25, 0.50, 0.75), (0.33, 0.66, 0.90))

#: Rows per categorization request and its prompt text.
PROMPT_BATCH_SIZE = 230
CATEGORY_PROMPT = """Please categorize following queries (instruction+input) into one of following 14 categories: 
1. Factual Question Answering (QA), 
2. Open-ended/Opinion-based Queries 
3. Creative Text Generation 
4. Instruction Following
5. Mathematics/Problem Solving 
6. Recommendation Systems 
7. Coding/Programming 
8. Summarization/ParaphrasingTasks 
9. Translation Tasks 
10. Reasoning/Logic Questions 
11. Dialogue/Conversational Queries 
12. Comparative/Analytical Queries 
13. Miscellaneous/Other 
14. General Advice/Personal Tasks

by adding a new column "category" to each query. Please only return the query ID and its category number to me in a format like: {"id":"itwgpt4\\/33289","category":7}, ... Thanks!"""


# ---------------------------------------------------------------------------
# Tunables
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class LabelThresholds:
    """Thresholds of the ground-truth labelling decision list."""

    discrepancy: float = 0.0
    trash_count: int = 3
    repetition_count: int = 3
    runtime_buffer: float = 1.5
    length_buffer: float = 1.5


@dataclass(frozen=True)
class SplitConfig:
    """Complexity filter and ordered train/test split of the routers."""

    exclude_percentile: float = 80.0
    train_ratio: float = 0.9


@dataclass(frozen=True)
class SweepConfig:
    discrepancy_thresholds: tuple = DISCREPANCY_THRESHOLDS
    probability_thresholds: tuple = PROBABILITY_THRESHOLDS
    split: SplitConfig = field(default_factory=SplitConfig)
