"""op1: near duplicates of all documents."""

from vigil.llm.common import table
from vigil.llm.ngram_join import near_duplicates
from vigil.llm.registry import query


@query("op1_ngram_join")
def op1_ngram_join(spark, sf_dir):
    """Groups of documents linked by a 5-word Jaccard similarity of 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"))
