"""Texts that hold the added tokens of the vocabulary, against the library at its default."""

import zlib

import numpy as np
import public_tokenizers

from paperweir.llm import token_files
from paperweir.llm.common import shared_dir

TEXTS = [
    "one <|endoftext|> two", "one<|endoftext|>two", "<|startoftext|>", "a <|startoftext|>b <|endoftext|>", "it's<|startoftext|><|endoftext|>!",
    "<|ENDOFTEXT|> <|EndOfText|>x", "<|endoftext |> <|endof text|> <|endoftext", "é<|endoftext|>é 12<|startoftext|>3", "<|endoftext|>\n\t<|endoftext|>", "one two",
]


def test_added_tokens_are_those_of_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    assert library.encode(TEXTS[0], add_special_tokens=False).ids == [637, 49407, 1237]
    path = shared_dir(spark, "added")
    token_files.write_tokens(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), path, files=2)
    rows = token_files.with_starts(token_files.with_crc32(token_files.read_tokens(spark, path))).orderBy("doc_id").collect()
    start = 0
    for r, (i, t) in zip(rows, enumerate(TEXTS), strict=True):
        ids = [*library.encode(t, add_special_tokens=False).ids, token_files.END_ID]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        start += len(ids)
