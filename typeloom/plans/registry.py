"""The registered features: 56 names, what each is computed from and which settings it needs."""

from __future__ import annotations

from collections.abc import Collection, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from typeloom.operators.sequences import TIER1

#: Always needed: groups below it are flagged.
SANITY = "tier1.filtering.sanity_check_min_keydown_count"
REPEATS = "tier1.keys.exclude_repeats"
#: Settings by a rhythm feature's first part, besides the one on repeats; then by whole names.
BY_FAMILY = {"burst": ("tier1.burst.gap_threshold_ms",), "revision": ("tier1.keys.deletion_keys", "tier1.keys.insertion_special_keys")}
BY_NAME = {
    "kit_long_pause_fraction": ("tier1.pause.long_pause_multiplier",),
    "kit_pause_time_fraction": ("tier1.pause.long_pause_multiplier",),
    "kit_pause_entropy": ("tier1.pause.entropy_bins",),
    "mouse_path_length": ("tier1.mouse.path_length_per_keys",),
    "code_length_relative_to_prompt": ("tier2.indentation.canonical_unit",),
    **dict.fromkeys(("ttr", "hapax_ratio", "word_entropy", "non_stopword_ratio"), ("tier2.text",)),
}
#: Names of the registered features, in the order of emission.
CODE = ("identifier_diversity", "identifier_diversity_no_boilerplate", "identifier_reuse_hapax", "identifier_reuse_hapax_no_boilerplate", "token_entropy", "comment_density", "control_flow_keyword_ratio", "function_call_density")
EXPLANATION = ("ttr", "hapax_ratio", "word_entropy", "non_stopword_ratio", "sentence_length_cv", "noun_ratio", "verb_ratio", "adj_ratio", "adv_ratio")
FORMAT = ("code_length_relative_to_prompt", "blank_line_ratio", "comment_to_code_ratio")
#: Features that can't be told without a part-of-speech tagger.
TAGGED = ("noun_ratio", "verb_ratio", "adj_ratio", "adv_ratio")


@dataclass(frozen=True)
class Feature:
    """A registered feature: ``column`` is its name among the computed columns."""

    tier: str
    r_t: str
    prefix: str
    column: str

    @property
    def name(self) -> str:
        return f"{self.prefix}_{self.column}"

    @property
    def source(self) -> str:
        """rhythm, code, lines or language: the part of the plan that computes it."""
        if self.tier == "tier1":
            return "rhythm"
        if self.r_t == "explanation":
            return "language"
        return "lines" if self.column in ("comment_density", "blank_line_ratio", "comment_to_code_ratio") else "code"

    @property
    def needs(self) -> tuple[str, ...]:
        own = BY_NAME.get(self.column, ())
        if self.tier != "tier1":
            return own
        return (REPEATS, *BY_FAMILY.get(self.column.partition("_")[0], ()), *own) if self.column != "cursor_jump_rate" else ()

    @property
    def description(self) -> str:
        return self.column.replace("_", " ")


def features() -> list[Feature]:
    """All of them, in the order in which a group's rows are emitted."""
    kinds = (("tier1", "code", "tier1_code", TIER1), ("tier1", "explanation", "tier1_explanation", TIER1), ("tier2", "code", "tier2_code", CODE), ("tier2", "explanation", "tier2_explanation", EXPLANATION), ("tier3", "code", "tier3_llm", FORMAT))
    return [Feature(tier, r_t, prefix, column) for tier, r_t, prefix, columns in kinds for column in columns]


def names() -> list[str]:
    return [f.name for f in features()]


def chosen(only: Collection[str] | None = None, without: Collection[str] | None = None) -> list[Feature]:
    """The features to compute: all, only some, or all but some; an unknown name or an empty choice is an error."""
    if only is not None and without is not None:
        raise ValueError("give the features to compute or those to leave out, not both")
    unknown = sorted({*(only or ()), *(without or ())} - set(names()))
    if unknown:
        raise ValueError(f"unknown features: {', '.join(unknown)}")
    out = [f for f in features() if (only is None or f.name in only) and f.name not in (without or ())]
    if not out:
        raise ValueError("no feature is chosen")
    return out


def required_keys(some: Iterable[Feature]) -> set[str]:
    """Dotted keys of the settings that these features read."""
    return {SANITY, REPEATS}.union(*(f.needs for f in some))


def catalog(spark: SparkSession, some: Iterable[Feature] | None = None) -> DataFrame:
    """feature, tier, r_t, source, description, ordered by feature."""
    rows = sorted((f.name, f.tier, f.r_t, f.source, f.description) for f in (features() if some is None else some))
    return spark.createDataFrame(rows, "feature string, tier string, r_t string, source string, description string")
