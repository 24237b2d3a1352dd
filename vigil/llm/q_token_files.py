"""op3: token-id files of all documents."""

import uuid

from vigil.llm.common import table
from vigil.llm.registry import query
from vigil.llm.token_files import read_tokens, write_tokens
from vigil.llm.tokens import read_vocabulary
from vigil.session import ensure_checkpoint_dir

VOCABULARY = "word_bpe_49k.json"
VOCABULARY_SIZE = 49408


@query("op3_token_files")
def op3_token_files(spark, sf_dir):
    """Write all documents' ids with a shared dictionary, then read them back."""
    import public_tokenizers

    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-token-files-{uuid.uuid4().hex[:12]}"
    write_tokens(table(spark, sf_dir, "documents"), folder, read_vocabulary(public_tokenizers.path(VOCABULARY)), 2, VOCABULARY_SIZE)
    return read_tokens(spark, folder)
