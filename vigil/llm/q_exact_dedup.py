"""op6: exact duplicates of all documents."""

from vigil.llm.common import table
from vigil.llm.exact_dedup import exact_groups
from vigil.llm.registry import query

SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@query("op6_exact_dedup", SQL)
def op6_exact_dedup(spark, sf_dir):
    """Block-naming groups of equal texts, one row per document."""
    return exact_groups(table(spark, sf_dir, "documents"))
