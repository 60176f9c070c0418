"""Named defaults of a ranking job and learner presets."""

from __future__ import annotations

from dataclasses import dataclass, field

# Defaults of the ranking job.
FOLDS = 10
SEED = 42
SVD_COMPONENTS = 200
SVD_ITERATIONS = 25
MAX_FEATURES = 200_000
MIN_DF = 2
MAX_DF = 0.9
STOP_ROUNDS = 5
VECTOR_WIDTH = 300
NDCG_SCALE = 100_000
# Places that count in the ranking objective, and trees of a forest.
RANK_POSITIONS = 20
FOREST_TREES = 1000

# Trees that are fitted between two looks at the valid loss.
STOP_CHUNK = 5

TEXT_COLUMNS = ("context_2", "context_1", "context_0", "reply")


@dataclass(frozen=True)
class BoostPreset:
    """Settings of a boosted-tree learner, by their common names."""

    trees: int = 100
    rate: float = 0.1
    leaves: int = 31
    min_rows: int = 20
    bins: int = 255
    row_share: float = 1.0
    feature_share: float = 1.0
    seed: int = SEED

    @property
    def depth(self) -> int:
        """Level-wise depth whose full tree holds at least ``leaves`` leaves."""
        return max(1, (self.leaves - 1).bit_length())


# The learner settings used by the job's variants.
BOOST_PRESETS = {
    "embedding": BoostPreset(trees=100, rate=0.1, leaves=20, min_rows=50, bins=256),
    "lexical": BoostPreset(
        trees=150, rate=0.03, leaves=50, min_rows=20, bins=1024, row_share=0.95, feature_share=0.9
    ),
    "word_vectors": BoostPreset(trees=500),
    "mixed": BoostPreset(),
    "xgb": BoostPreset(trees=1000, rate=0.1, leaves=8, min_rows=1, bins=256),
    "cat": BoostPreset(trees=1000, rate=0.03, leaves=64, min_rows=1, bins=254),
    "lgbm": BoostPreset(trees=1000),
}


@dataclass(frozen=True)
class LexicalSettings:
    """Analyzer ranges and vocabulary limits of the lexical features."""

    char_range: tuple[int, int] = (2, 5)
    word_range: tuple[int, int] = (1, 3)
    min_df: int = MIN_DF
    max_df: float = MAX_DF
    max_features: int = MAX_FEATURES
    components: int | None = SVD_COMPONENTS
    iterations: int = SVD_ITERATIONS
    text_columns: tuple[str, ...] = field(default=TEXT_COLUMNS)
