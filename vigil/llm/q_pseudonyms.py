"""op5: pseudonyms in all documents."""

from vigil.llm.common import table
from vigil.llm.pseudonyms import pseudonymize
from vigil.llm.registry import query


#: For made-up texts; real ones take theirs from the session's configuration.
TEST_KEY = "a key for tests"


@query("op5_pseudonyms")
def op5_pseudonyms(spark, sf_dir):
    """Whole texts with validated numbers, dates, addresses and keys permuted within their format."""
    key = spark.conf.get("spark.vigil.pseudonyms.key", TEST_KEY)
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), key.encode())
