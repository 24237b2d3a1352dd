"""op4: mix of all documents to source targets."""

from vigil.llm.common import table
from vigil.llm.mixing import mix
from vigil.llm.registry import query


@query("op4_mixing")
def op4_mixing(spark, sf_dir):
    """Efraimidis-Spirakis mix, weights 5, 2, 1 over the sources, 150 % of all words."""
    return mix(table(spark, sf_dir, "documents"))
