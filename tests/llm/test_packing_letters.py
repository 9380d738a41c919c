"""Words that the packing encodes apart have the ids of the tokenizer's plain call."""

import numpy as np

from brightloom.llm.packing import Encoder


def test_ids_of_odd_words_are_those_of_the_plain_call():
    encode = Encoder()
    texts = [f"a{chr(c)}b {chr(c)}, {chr(c)}{chr(c)}.! Word{chr(c)}'s {chr(c)}''" for c in [*range(33, 0x250), 0x3A3, 0x3C2, 0x301, 0x958, 0x9DC, 0xFB2A, 0x4E2D]]
    texts += ["", " ", "Two words$$$ don't,### <|endoftext|> end", "a\nb\tc  d"]
    plain = encode.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in plain]
