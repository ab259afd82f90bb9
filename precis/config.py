"""Parameters and fixed values.

Everything here is validated on the driver, before any plan is built, so a bad
parameter fails fast instead of inside a task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

# --- fixed values (must equal the behaviour being matched) -------------------
MIN_SENTENCE_LENGTH = 40  # characters, inclusive
MAX_SENTENCE_LENGTH = 1000  # characters, inclusive
MIN_WORDS_COUNT = 8  # filtered tokens, duplicates counted
LONG_SENTENCE_RESPLIT = 200  # clean splitter re-splits pieces longer than this
MIN_VALID_SENTENCE_CHARS = 10  # clean splitter drops shorter pieces
CHUNK_SIZE = 1024 * 1024  # characters per slice in the chunked processor
ALLOWED_EXTENSIONS = ("txt", "md", "epub")

# Blended score weights and penalties (diverse algorithm).
WEIGHT_TFIDF = 0.5
WEIGHT_POSITION = 0.3
WEIGHT_LENGTH = 0.2
POSITION_DECAY = 0.05
NEAR_DISTANCE = 3  # |idx_a - idx_b| < 3 is "near"
NEAR_PENALTY = 0.3
SIMILAR_LENGTH = 5  # |len_a - len_b| < 5 is "similar"
SIMILAR_PENALTY = 0.8

# English stop words (fixed values). Entries containing an apostrophe are left
# out: a token with an apostrophe never passes the alphanumeric test, so they
# could never match.
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves
    he him his himself she her hers herself it its itself they them their
    theirs themselves what which who whom this that these those am is are was
    were be been being have has had having do does did doing a an the and but
    if or because as until while of at by for with about against between into
    through during before after above below to from up down in out on off over
    under again further then once here there when where why how all any both
    each few more most other some such no nor not only own same so than too
    very s t can will just don should now d ll m o re ve y ain aren couldn
    didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn
    weren won wouldn
    """.split()
)

# Abbreviations that do not end a sentence in the clean splitter (fixed values).
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Jr", "St", "vs", "etc", "e.g", "i.e")

ALGORITHMS = ("default", "diverse")
PROCESSORS = ("clean", "raw", "chunked", "trained")
# Other names that callers may use (fixed values): algorithm "dask" is the diverse algorithm; processor "default"
# is the clean splitter and "dask" the chunked one.
ALGORITHM_ALIASES = {"dask": "diverse"}
PROCESSOR_ALIASES = {"default": "clean", "dask": "chunked"}


def termination_cap(num_sentences: int, early_termination_factor: float) -> int:
    """Number of valid sentences kept per document.

    Reading stops once ``count >= max(10*N, 200) * f``, so the count kept is the
    smallest integer reaching that bound.
    """
    return int(math.ceil(max(num_sentences * 10, 200) * early_termination_factor))


@dataclass(frozen=True)
class SummaryConfig:
    num_sentences: int = 3
    early_termination_factor: float | None = None
    algorithm: str = "default"
    processor: str = "clean"

    def __post_init__(self) -> None:
        object.__setattr__(self, "algorithm", ALGORITHM_ALIASES.get(self.algorithm, self.algorithm))
        object.__setattr__(self, "processor", PROCESSOR_ALIASES.get(self.processor, self.processor))
        if isinstance(self.num_sentences, bool) or not isinstance(self.num_sentences, int):
            raise ValueError("num_sentences must be an integer")
        if self.num_sentences <= 0:
            raise ValueError("num_sentences must be greater than 0")
        f = self.early_termination_factor
        if f is not None and (not isinstance(f, (int, float)) or not (1.0 <= float(f) <= 10.0)):
            raise ValueError("early_termination_factor must be between 1 and 10")
        if self.algorithm not in ALGORITHMS:
            raise ValueError(f"algorithm must be one of {ALGORITHMS}")
        if self.processor not in PROCESSORS:
            raise ValueError(f"processor must be one of {PROCESSORS}")

    @property
    def cap(self) -> int | None:
        """Valid sentences kept per document; None without a factor: all."""
        if self.early_termination_factor is None:
            return None
        return termination_cap(self.num_sentences, float(self.early_termination_factor))
