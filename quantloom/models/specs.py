"""Model identifiers with their feature sets and settings. Fixed values; re-aimed at Spark ML where noted.

Gradient-boosting libraries become ``gbt``. The date-grouped ranker becomes a pointwise regression on per-date
percentile ranks with a sigmoid on top. Depth and tree counts are kept, penalties Spark ML lacks are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from quantloom.functions.vocabulary import CROSS_SECTION, FUNDAMENTAL, LAG, MACRO, PRICE, SECTOR, SENTIMENT, TECHNICAL

ALL = TECHNICAL + FUNDAMENTAL + SENTIMENT


@dataclass(frozen=True)
class Spec:
    model_id: str
    features: tuple[str, ...]
    parts: tuple[tuple[str, dict[str, Any]], ...] = field(default_factory=tuple)

    def with_settings(self, **settings: Any) -> Spec:
        """Copy with settings overridden in every part that knows them."""
        known = lambda kind, p: {k: v for k, v in settings.items() if k in p or (kind, k) in _OPTIONAL}
        return replace(self, parts=tuple((kind, {**p, **known(kind, p)}) for kind, p in self.parts))

    def with_features(self, features: list[str]) -> Spec:
        return replace(self, features=tuple(features))


_OPTIONAL = {("gbt", "maxBins"), ("forest", "maxBins"), ("ranker", "maxBins")}

SPECS = {
    s.model_id: s
    for s in [
        Spec("baseline_lr", tuple(TECHNICAL), (("logistic", {"maxIter": 2000, "C": 1.0}),)),
        Spec("model_a", tuple(TECHNICAL), (("gbt", {"maxIter": 200, "maxDepth": 4, "stepSize": 0.05}),)),
        Spec("model_b", tuple(TECHNICAL + FUNDAMENTAL), (("gbt", {"maxIter": 300, "maxDepth": 5, "stepSize": 0.05}),)),
        Spec("model_c", tuple(TECHNICAL + SENTIMENT), (("forest", {"numTrees": 300, "maxDepth": 8}),)),
        Spec(
            "model_d",
            tuple(ALL),
            (("gbt", {"maxIter": 400, "maxDepth": 5, "stepSize": 0.03, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}),),
        ),
        Spec(
            "model_e",
            tuple(ALL),
            (("gbt", {"maxIter": 450, "maxDepth": 10, "stepSize": 0.045, "minInstancesPerNode": 24, "maxBins": 255, "validationFraction": 0.12}),),
        ),
        Spec(
            "model_f",
            tuple(ALL),
            (
                ("gbt", {"maxIter": 500, "maxDepth": 6, "stepSize": 0.04, "subsamplingRate": 0.85, "featureSubsetStrategy": "0.85", "minInstancesPerNode": 3}),
                ("gbt", {"maxIter": 500, "maxDepth": 6, "stepSize": 0.04, "subsamplingRate": 0.85, "featureSubsetStrategy": "0.85", "minInstancesPerNode": 24}),
            ),
        ),
        Spec("model_g_ranker", tuple(ALL), (("ranker", {"maxIter": 300, "maxDepth": 6, "stepSize": 0.05}),)),
    ]
}

FOREST = Spec("research_forest", tuple(ALL + LAG), (("forest", {"numTrees": 200, "maxDepth": 12, "minInstancesPerNode": 4}),))
META = Spec("meta_forest", (), (("forest", {"numTrees": 250, "maxDepth": 10, "minInstancesPerNode": 4}),))
PCA_LOGISTIC = Spec("pca_logistic", tuple(ALL + LAG), (("pca_logistic", {"maxIter": 1200, "C": 1.0, "variance": 0.95}),))

STRATEGY_GROUPS = {
    "technical_only": TECHNICAL + LAG,
    "fundamental_strategy": FUNDAMENTAL,
    "alternative_data_strategy": SENTIMENT,
    "hybrid_strategy": TECHNICAL + LAG + FUNDAMENTAL + SENTIMENT,
    "tech_fund": TECHNICAL + LAG + FUNDAMENTAL,
}

ABLATION_STEPS = {
    "A: Technical": TECHNICAL + LAG + CROSS_SECTION,
    "B: +Macro/Sector/Price": TECHNICAL + LAG + MACRO + SECTOR + PRICE + CROSS_SECTION,
    "C: +Fundamental": TECHNICAL + LAG + MACRO + SECTOR + PRICE + FUNDAMENTAL + CROSS_SECTION,
    "D: +Sentiment (all)": TECHNICAL + LAG + MACRO + SECTOR + PRICE + FUNDAMENTAL + SENTIMENT + CROSS_SECTION,
}


def spec_of(model_id: str) -> Spec:
    if model_id not in SPECS:
        raise ValueError(f"unknown model id {model_id!r}")
    return SPECS[model_id]
