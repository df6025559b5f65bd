"""Model queries hand the whole settings of ``models.specs`` to their fits; no parameter shortens them."""

import pytest

from quantloom.models.specs import ABLATION_STEPS, FOREST, SPECS
from quantloom.plans import modelling
from quantloom.plans.catalog import ENTRIES


class Asked(Exception):
    """What a fit was asked for."""


def asked(*what, **named):
    raise Asked(what, named)


def parts_asked(spark, monkeypatch, name):
    monkeypatch.setattr(modelling, "roles", lambda spark, sf_dir: dict.fromkeys(("train", "validation", "test")))
    monkeypatch.setattr(modelling.training, "fit", asked)
    with pytest.raises(Asked) as seen:
        ENTRIES[name].run(spark, "nowhere")
    return seen.value.args[0][0].parts


def test_feature_importances_grows_all_trees(spark, monkeypatch):
    assert parts_asked(spark, monkeypatch, "feature_importances") == FOREST.parts


def test_research_cv_summary_grows_all_trees(spark, monkeypatch):
    monkeypatch.setattr(modelling, "training_panel", lambda spark, sf_dir: spark.createDataFrame([], "date date"))
    monkeypatch.setattr(modelling.splits, "research_schemes", lambda dates: {})
    monkeypatch.setattr(modelling.folds, "build", lambda *what: None)
    monkeypatch.setattr(modelling.folds, "scores", asked)
    with pytest.raises(Asked) as seen:
        ENTRIES["research_cv_summary"].run(spark, "nowhere")
    _, groups, spec = seen.value.args[0]
    assert groups == ABLATION_STEPS and spec == FOREST


def test_research_run_shortens_nothing(spark, monkeypatch):
    """The study gets its own models (the principal-component one among them), groups and number of draws, and fits of whole specs."""
    import inspect

    study = inspect.signature(modelling.workflows.research_run)
    monkeypatch.setattr(modelling, "training_panel", lambda spark, sf_dir: "panel")
    monkeypatch.setattr(modelling, "cv_scores", lambda spark, sf_dir: "scores")
    monkeypatch.setattr(modelling.workflows, "research_run", asked)
    with pytest.raises(Asked) as seen:
        ENTRIES["research_run"].run(spark, "nowhere")
    what, named = seen.value.args
    got = study.bind(*what, **named)
    got.apply_defaults()
    whole = study.bind("panel", cv="scores")
    whole.apply_defaults()
    assert got.arguments == whole.arguments


@pytest.mark.parametrize("model", SPECS)
def test_score_queries_run_all_rounds(spark, monkeypatch, model):
    assert parts_asked(spark, monkeypatch, f"score_{model}") == SPECS[model].parts


def test_training_run_runs_all_rounds(spark, monkeypatch):
    assert parts_asked(spark, monkeypatch, "training_run") == SPECS["model_b"].parts


@pytest.mark.parametrize("name", ["tree_attributions", "tree_attribution_sums", "tree_base_value"])
def test_attributions_explain_the_whole_model(spark, monkeypatch, name):
    assert parts_asked(spark, monkeypatch, name) == SPECS["model_a"].parts
