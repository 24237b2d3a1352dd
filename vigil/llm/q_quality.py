"""op2: quality of all documents."""

from pyspark.sql import functions as F

from vigil.llm.common import fold, table
from vigil.llm.quality_crf import score, train
from vigil.llm.registry import query


@query("op2_quality")
def op2_quality(spark, sf_dir):
    """CRF trained outside the held-out fold, all documents scored."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
