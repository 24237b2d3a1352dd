"""op13: whitened embeddings."""

from vigil.llm.common import table
from vigil.llm.registry import query
from vigil.llm.whitening import whiten


@query("op13_whitening")
def op13_whitening(spark, sf_dir):
    """All vectors on the eight leading components of their weighted covariance."""
    return whiten(table(spark, sf_dir, "embeddings"))
