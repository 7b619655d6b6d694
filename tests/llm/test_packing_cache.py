import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from finescale.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


class Unwalked(dict):
    def __iter__(self):
        raise AssertionError("a lookup walks the whole generation")


def test_lookups_do_not_walk_the_older_generation():
    words, plain = packing.WordIds(PATH), Tokenizer.from_file(PATH)
    words.encode(pa.array(["one two three"], pa.large_string()))
    words.older, words.known = Unwalked(words.known), {}
    text = "two four. three five"
    assert np.frombuffer(words.encode(pa.array([text], pa.large_string()))[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert {b"two", b"three"} <= set(words.known)
