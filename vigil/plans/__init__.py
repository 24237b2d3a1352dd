"""Composite jobs and the registry of named queries."""


def load_all():
    """Import every query module so REGISTRY is complete."""
    from vigil.plans import q_clean, q_explain, q_facts, q_features, q_models, q_rules, q_sources, q_streaming  # noqa: F401
    from vigil.plans.registry import REGISTRY

    return REGISTRY
