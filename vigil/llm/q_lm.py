"""op9: language-model scores of all documents."""

from vigil.llm.common import table
from vigil.llm.interpolated_lm import lm_scores
from vigil.llm.registry import query


@query("op9_lm")
def op9_lm(spark, sf_dir):
    """Deleted interpolation of word pairs, words and the uniform estimate."""
    return lm_scores(table(spark, sf_dir, "documents"))
