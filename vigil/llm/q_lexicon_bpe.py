"""op11: all documents encoded with a lexicon automaton and decoded again."""

from pyspark.sql import functions as F

from vigil.llm.common import table
from vigil.llm.lexicon_bpe import decoded, encoded, lexicon
from vigil.llm.registry import query
from vigil.llm.tokens import read_vocabulary

VOCABULARY = "byte_bpe_50k.json"


@query("op11_lexicon_bpe")
def op11_lexicon_bpe(spark, sf_dir):
    """Ids of every text by the automaton of the corpus's frequent words, and the text back from its ids."""
    import public_tokenizers

    docs, vocabulary = table(spark, sf_dir, "documents"), read_vocabulary(public_tokenizers.path(VOCABULARY))
    rows = decoded(encoded(docs, vocabulary, lexicon(docs, vocabulary)), vocabulary)
    return rows.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
