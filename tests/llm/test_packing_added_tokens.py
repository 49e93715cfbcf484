"""Ids of texts with an added token's content, against a tokenizer as the library gives it."""

from tokenizers import Tokenizer

from tessera.llm import packing


def test_ids_equal_the_untouched_tokenizer(spark):
    tok = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y\n", "<|endoftext| >", "w" * 3000 + "<|endoftext|>", "plain"]
    encode = packing.encoder(packing.default_tokenizer())
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [encode(t) for t in texts] == want and want[1] == [50256]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.doc_tokens for r in packing.pack(docs).collect()} == {k: len(w) + 1 for k, w in enumerate(want)}
