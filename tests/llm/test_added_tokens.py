import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from duplika.llm.queries import WORD_BPE
from duplika.llm.tokens import WordEncoder

TEXTS = ["plain", None, "a<|endoftext|>b", "<|startoftext|>", "", "It's <|EndOfText|> no token", "x <|endoftext|><|endoftext|> été 日", "last"]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("end_id", [None, 2])
def test_ids_as_the_library_has_them(kind, end_id):
    own = Tokenizer.from_file(WORD_BPE)
    flat, offsets = WordEncoder(WORD_BPE).encode(pa.array(TEXTS, kind), end_id)
    got = [x.tolist() for x in np.split(flat, offsets[1:-1])]
    assert got == [own.encode(t or "", add_special_tokens=False).ids + ([] if end_id is None else [end_id]) for t in TEXTS]
