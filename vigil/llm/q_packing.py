"""op8: all documents in sequences of 4096 tokens."""

from vigil.llm.common import table
from vigil.llm.packing import best_fit_packing
from vigil.llm.registry import query
from vigil.llm.tokens import read_vocabulary


def vocabulary() -> str:
    import public_tokenizers

    return read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))


@query("op8_packing")
def op8_packing(spark, sf_dir):
    """Bin completion over the pieces of all documents."""
    return best_fit_packing(table(spark, sf_dir, "documents"), vocabulary())
