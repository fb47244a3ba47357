"""Parameters of the audit. Lexicons, entity names and phrases are inputs; nothing here names a research field."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

# Section names with their heading patterns in order of priority, and the sections that coverage counts.
SECTION_PATTERNS: dict[str, tuple[str, ...]] = {
    "abstract": (r"\babstract\b",),
    "introduction": (r"\b1\.?\s+introduction\b", r"\bintroduction\b"),
    "related_work": (r"\brelated work\b", r"\bbackground\b"),
    "method": (r"\bmethod(?:ology)?\b", r"\bapproach\b", r"\bproposed method\b"),
    "experiments": (r"\bexperiments?\b", r"\bexperimental results?\b", r"\bevaluation\b"),
    "limitations": (r"\blimitations?\b", r"\bdiscussion\b"),
    "conclusion": (r"\bconclusions?\b",),
    "references": (r"\breferences\b",),
}
EXPECTED_SECTIONS = ("abstract", "introduction", "method", "experiments", "conclusion")
# Hosts that make a link a code link; words that aren't data set names, those of the first and those of the second audit.
CODE_HOSTS = ("github.com", "gitlab.com", "huggingface.co", "project")
NOT_DATASETS = ("the", "our", "this", "new", "large", "public")
GENERIC = ("open", "training", "comprehensive", "enhanced", "each", "our", "new", "public", "large", "real", "synthetic", "benchmark", "evaluation", "test", "validation", "image", "video", "medical", "multimodal", "multi-modal")


@dataclass(frozen=True)
class Role:
    """An evidence role: the sections read, in order, how much of them, the phrases sought, and how many sentences stay."""

    name: str
    sections: tuple[str, ...]
    phrases: tuple[str, ...]
    max_chars: int
    cap: int
    number_bonus: bool = False


# Sections, prefix and cap of each role; phrases come from the user.
ROLE_SHAPES = {
    "research_problem": (("abstract", "introduction", "front_matter"), 16_000, 3, False),
    "method_claims": (("method", "introduction"), 18_000, 4, False),
    "contribution_claims": (("abstract", "introduction", "front_matter"), 16_000, 4, False),
    "experiment_protocol": (("experiments", "conclusion", "limitations"), 22_000, 4, False),
    "main_results": (("experiments", "conclusion", "limitations"), 22_000, 4, True),
    "ablation_evidence": (("experiments", "conclusion", "limitations"), 22_000, 4, False),
    "limitation_evidence": (("limitations", "conclusion", "experiments"), 14_000, 3, False),
    "implementation_evidence": (("experiments", "conclusion", "limitations"), 22_000, 4, False),
}


def roles(phrases: dict[str, tuple[str, ...]]) -> tuple[Role, ...]:
    return tuple(Role(name, sections, tuple(phrases.get(name, ())), chars, cap, bonus) for name, (sections, chars, cap, bonus) in ROLE_SHAPES.items())


@dataclass(frozen=True)
class Weight:
    theme: str
    weight: float
    cap: int | None = None


@dataclass(frozen=True)
class Quota:
    theme: str
    quota: int


# Features, the largest share of documents a term may be in, starts, rounds and batches of k-means, and dimensions (the first audit's are our own), for the first and the second audit.
V1_STRATA = {"features": 30_000, "max_df": 1.0, "tries": 10, "rounds": 150, "batch": 512, "dims": 160}
V2_STRATA = {"features": 40_000, "max_df": 0.92, "tries": 20, "rounds": 300, "batch": 256, "dims": 160}


@dataclass(frozen=True)
class Audit:
    """One audit. direct: theme weights of the direct score; quotas: in order of priority; target: how many documents are selected."""

    lexicon: dict[str, tuple[str, ...]]
    phrases: dict[str, tuple[str, ...]] = field(default_factory=dict)
    datasets: tuple[str, ...] = ()
    not_datasets: tuple[str, ...] = tuple(dict.fromkeys(NOT_DATASETS + GENERIC))
    metrics: tuple[str, ...] = ()
    direct: tuple[Weight, ...] = ()
    quotas: tuple[Quota, ...] = ()
    target: int = 1000
    strata: int = 45
    least_words: int = 3000
    least_coverage: float = 0.6
    year: int | None = None
    venue: str | None = None
    seed: int = 3407
    phrase_mode: bool = True
    stop_words: tuple[str, ...] | None = None  # None: the English ones that Spark has

    def __post_init__(self):
        if self.target < 1 or self.strata < 1:
            raise ValueError("target and strata are at least 1")


def from_environment(audit: Audit) -> tuple[Audit, str, str]:
    """The audit with its target, the corpus root and the output folder as AUDIT_TARGET, AUDIT_ROOT and AUDIT_OUT have them."""
    from dataclasses import replace

    return replace(audit, target=int(os.environ.get("AUDIT_TARGET", audit.target))), os.environ.get("AUDIT_ROOT", "corpus"), os.environ.get("AUDIT_OUT", "audit")
