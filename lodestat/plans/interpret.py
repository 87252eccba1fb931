"""A reading of a result in plain words, from its own numbers alone."""

from __future__ import annotations

from typing import Any

#: What a family of analyses can say and what it cannot; tests to turn to if its assumptions fail (texts of this engine).
FAMILIES: dict[str, dict[str, Any]] = {
    "difference": {"of": ("welch_t_test", "mann_whitney", "one_way_anova", "kruskal_wallis", "two_way_anova", "paired_t_test", "wilcoxon_signed_rank", "one_sample_t_test", "one_sample_z_test", "two_proportion_z", "log_rank"), "claim": "It compares levels of the outcome.", "limit": "A difference between groups is not yet an effect of what sets them apart."},
    "association": {"of": ("pearson", "spearman", "kendall", "point_biserial", "correlation_matrix", "partial_correlation", "chi_square", "crosstab", "fisher_exact", "mcnemar"), "claim": "It tells whether two columns go together.", "limit": "Columns that go together need not cause each other; a third may move both."},
    "model": {"of": ("linear_regression", "logistic_regression", "probit", "linear_probability_model", "poisson_regression", "negative_binomial", "zero_inflated", "hurdle", "tobit", "ordinal_logit", "quantile_regression", "ridge_regression", "ridge_lasso"), "claim": "It tells how the outcome changes with each feature while the others are held.", "limit": "Coefficients hold inside the range of the data, and only if no feature that matters is left out."},
    "reliability": {"of": ("cronbach_alpha", "omega", "likert_analysis", "fleiss_kappa", "icc", "cohens_kappa"), "claim": "It tells how well items or raters agree.", "limit": "Agreement is not correctness: all may be wrong together."},
    "description": {"of": ("descriptive", "frequency", "weighted_frequencies", "normality_tests", "kaplan_meier"), "claim": "It describes these rows.", "limit": "It says nothing on rows that are not here."},
    "learning": {"of": ("logistic_regression_classification", "decision_tree", "random_forest", "random_forest_regression", "kmeans", "pca"), "claim": "It finds structure that predicts or groups rows.", "limit": "What holds on these rows may not hold on new ones unless test rows say so."},
}
OTHER = {"claim": "It sums up these rows.", "limit": "It is to be read with its tables."}
INSTEAD = {"welch_t_test": "mann_whitney", "one_way_anova": "kruskal_wallis", "pearson": "spearman", "linear_regression": "quantile_regression", "chi_square": "fisher_exact", "paired_t_test": "wilcoxon_signed_rank"}
SMALL = 30


def _number(x: Any) -> str:
    return f"{x:.4g}" if isinstance(x, float) else str(x)


def interpret(result: dict[str, Any], alpha: float = 0.05) -> dict[str, Any]:
    """summary, limits, next steps and the evidence they rest on."""
    kind, n = result["analysis_type"], result.get("sample_size") or 0
    family = next((f for f in FAMILIES.values() if kind in f["of"]), OTHER)
    said, steps = [family["claim"]], []
    evidence: dict[str, Any] = {"sample_size": n, "status": result["status"]}
    if result["status"] != "ok":
        said.append(f"The analysis did not succeed ({result['status']}): its numbers are not to be used.")
    p = (result.get("test") or {}).get("p_value")
    if p is not None:
        evidence["p_value"] = p
        said.append(f"Chance alone would give this much or more with probability {_number(p)}, {'below' if p < alpha else 'not below'} {alpha:g}: {'the data speak against no effect' if p < alpha else 'the data do not tell it from no effect'}.")
    elif result["status"] == "ok":
        said.append("It gives no p-value; the estimates and their intervals are what counts.")
    effects = {k: v for k, v in (result.get("effect_size") or {}).items() if isinstance(v, (int, float))}
    if effects:
        evidence["effect_size"] = effects
        said.append("Size of the effect: " + ", ".join(f"{k.replace('_', ' ')} {_number(v)}" for k, v in effects.items()) + ".")
    interval = result.get("confidence_interval")
    if interval and None not in interval:
        evidence["confidence_interval"] = interval
        said.append(f"Values from {_number(interval[0])} to {_number(interval[1])} fit the data.")
    limits = [family["limit"]]
    if 0 < n < SMALL:
        limits.append(f"{n} rows explore, they do not confirm.")
    if result.get("warnings"):
        limits.append(f"{len(result['warnings'])} warnings come with the result.")
    bad = [c for c in (result.get("assumptions") or {}).get("checks", []) if c["status"] in ("WARN", "FAIL")]
    for c in bad:
        limits.append(f"{c['name']}: {c['detail']}.")
    if any(c["status"] == "FAIL" for c in bad) or any(c["name"] in ("Normality", "Outliers", "Equal variance", "Expected counts") for c in bad):
        steps.append(f"Run {INSTEAD[kind]} beside it." if kind in INSTEAD else "Mend the columns named above and run it again.")
    tests = (result.get("meta") or {}).get("multiple_comparisons")
    if tests:
        limits.append(f"{tests['tests']} p-values: some fall below {alpha:g} by chance; read the corrected ones.")
    if p is not None and p >= alpha and n < SMALL:
        steps.append("Gather more rows before concluding that there is nothing.")
    if family["claim"] == FAMILIES["description"]["claim"]:
        steps.append("Choose a test or a model for the question behind the description.")
    return {"summary": " ".join(said), "limits": limits, "next_steps": steps or ["Report the estimate with its interval, and the rows it rests on."], "evidence": evidence}
