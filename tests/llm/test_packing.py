import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from finescale.llm import packing
from tests.llm.common import HAVE, SF, documents

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [(1, "Some words, here. It's 12 o'clock <|endoftext|> é-ü"), (2, None), (3, ""), (4, "word " * 9000), (4, "word " * 9000),
         (None, "no id at all"), (5, "a\tb\nc  d"), (6, "x" * 3000), (7, "Éclair NAÏVE a²b")] + [(100 + i, "tail " * (i * 37 % 700)) for i in range(60)]


def test_every_id_once_and_gapless(spark):
    rows = packing.pack(documents(spark, TEXTS).repartition(3), PATH).collect()
    plain = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for doc, text in TEXTS:
        want[doc].append(np.array(plain.encode(text or "", add_special_tokens=False).ids + [1], "<u4"))
    got, sequences = defaultdict(lambda: defaultdict(list)), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and r.length > 0
        got[r.doc_id][r.start].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc, texts in want.items():
        assert sum(len(t) for t in texts) == sum(r.length for x in got[doc].values() for r in x)
        for x in got[doc].values():
            for r in x:
                assert r.doc_tokens == len(texts[0]) and bytes(r.ids) == texts[0][r.start:r.start + r.length].tobytes()
        at = 0
        for start in sorted(got[doc]):
            assert start <= at                     # repeated rows may be cut at other places
            at = max(at, start + max(r.length for r in got[doc][start]))
        assert at == len(texts[0])
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_little_padding_and_fixed_counts():
    rng = np.random.default_rng(5)
    packer = packing.Packer(2048, 0)
    for doc, n in enumerate(rng.integers(1, 6000, 2000).tolist()):
        start = 0
        for size in packing.cuts(n, 2048, 16):
            packer.add(doc, start, bytes(4 * size), n)
            start += size
        assert start == n
    full = packer.next
    per = defaultdict(list)
    for r in packer.rows:
        per[r[5]].append(r[2])
    for sizes in per.values():
        shares = {2048 // s for s in sizes}
        assert len(shares) == 1 and len(sizes) == shares.pop()
    packer.finish()
    tokens = defaultdict(int)
    for r in packer.rows:
        tokens[r[5]] += r[2]
    padding = sum(0 if t & (t - 1) == 0 else 2048 - t for t in tokens.values())
    assert padding < 0.01 * sum(tokens.values()) and full < len(tokens) <= full + 200


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(packing.WordIds, "LIMIT", 5)
    words, plain = packing.WordIds(PATH), Tokenizer.from_file(PATH)
    for text in ("one two three", "four five six seven", "one eight. nine"):
        assert np.frombuffer(words.encode(pa.array([text], pa.large_string()))[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_empty_table_and_digest(spark):
    assert packing.pack(documents(spark, []), PATH).collect() == []
    r = packing.pack(documents(spark, [(1, "a b")]), PATH).selectExpr("ids", "crc32(ids) AS c").first()
    assert r.c == zlib.crc32(bytes(r.ids))


def test_words_equal_the_tokenizer():
    """Whole documents, texts of odd signs, and letters that lower case or normalisation would change."""
    words, plain = packing.WordIds(PATH), Tokenizer.from_file(PATH)
    assert words.bytewise
    rng = random.Random(2)
    signs = "aBé ßÉ.,!?\n\t 1ıİΣσſǅé漢-'\"₂ñ́ Ω"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 80))) for _ in range(3000)] + ["", " ", "\n", "İ", "é. é."]
    if HAVE:
        texts += [t or "" for t in pq.read_table(SF.replace("sf0.001", "sf0.01") + "/documents.parquet").column("text").to_pylist()]
    want = [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
    for bytewise in (True, False):
        words.bytewise, words.known = bytewise, {}
        assert [np.frombuffer(x, "<u4").tolist() for x in words.encode(pa.array(texts, pa.large_string()))] == want


def test_checksums_instead_of_ids(spark):
    docs = documents(spark, TEXTS).repartition(3).cache()
    ids = {(r.doc_id, r.start, r.length, r.sequence_id, r.offset, zlib.crc32(bytes(r.ids))) for r in packing.pack(docs, PATH).collect()}
    got = packing.pack(docs, PATH, with_ids=False)
    assert {(r.doc_id, r.start, r.length, r.sequence_id, r.offset, r.ids_crc32) for r in got.collect()} == ids
