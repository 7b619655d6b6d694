"""Harmonic packing of tokenised documents into sequences.

Lengths fall into reciprocal-capacity classes: class j holds lengths in (capacity / (j + 1), capacity / j], and each of its
bins takes exactly j pieces. A document is first cut where that costs no padding: full sequences, then pieces of capacity /
2, / 4, ... that fill their class exactly; what remains is a small piece of class ``capacity // length``. Every Spark task
packs the rows it reads, on its own; no row is moved. At its end a task joins the pieces of its unfinished bins and cuts
them at powers of two, which take no padding, so that a task adds at most one short sequence of each power.

Null text counts as empty; an empty document is the end token alone. Repeated rows are packed as often as they occur, and a
null id stays null. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from finescale.llm.text import plain, raw, slices

SCHEMA = "doc_id bigint, start bigint, length bigint, {ids}, doc_tokens bigint, sequence_id bigint, offset bigint"


def _byte_signs() -> dict[int, str]:
    """Signs that byte-level vocabularies write for bytes: visible Latin-1 characters for themselves, the others from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


BYTE_SIGNS = _byte_signs()


class WordIds:
    """Token ids of texts, as little-endian 32-bit values, for a tokenizer that drops white space and reads lower case: such
    a tokenizer treats what stands between spaces alone, so that each distinct word is tokenised once."""

    LIMIT = 400_000                     # distinct words of a generation; a worker keeps two, and words in use move to the younger one

    PROBES = ("the", "straße", "coração", "zażółć", "internationalisation")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        # a model over bytes reads a word of lower-case letters as it stands; probes tell whether this tokenizer does nothing else to them
        self.bytewise = all([t.id for t in self.tokenizer.model.tokenize(w.encode().decode("latin-1").translate(BYTE_SIGNS))]
                            == self.tokenizer.encode(w, add_special_tokens=False).ids for w in self.PROBES)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of a ``plain`` array. Words become numbers first, so that each distinct one is looked up once, and ids are
        gathered by number."""
        data, offsets = raw(texts)
        data = np.where((data >= 65) & (data <= 90), data | 32, data)
        inside = (data != 32) & (data != 10)
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside)[:-1]))
        ends = np.flatnonzero(inside & (edge[1:] | ~np.append(inside, False)[1:])) + 1
        begin = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
        found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(begin), pa.py_buffer(data[inside])]).dictionary_encode()
        body, bounds = raw(found.dictionary)
        body, bounds = body.tobytes(), bounds.tolist()
        each = self._ids_of([body[a:z] for a, z in zip(bounds, bounds[1:])])
        flat = np.frombuffer(b"".join(each), "<u4")
        size = np.fromiter(map(len, each), np.int64, len(each)) >> 2
        at = found.indices.to_numpy(zero_copy_only=False)
        count = size[at]
        total = np.append(0, np.cumsum(count))
        ids = flat[np.repeat((np.cumsum(size) - size)[at] - total[:-1], count) + np.arange(total[-1])]
        bounds = total[np.searchsorted(starts, offsets)].tolist()
        return [ids[a:z].tobytes() for a, z in zip(bounds, bounds[1:])]

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        missing = set(words).difference(self.known)
        if len(self.known) + len(missing) > self.LIMIT:
            self.older, self.known = self.known, {}
            missing = set(words)
        older = self.older
        again = {w for w in missing if w in older}          # set.intersection would walk the whole older generation
        self.known.update(zip(again, map(older.__getitem__, again)))
        self._learn(missing - again)
        return list(map(self.known.__getitem__, words))

    def _learn(self, missing: set[bytes]) -> None:
        letters, plain_letters, others, ends = set(), set(), [], []
        for word in missing:
            if word.isalpha():                              # ASCII letters
                plain_letters.add(word)
                continue
            bare = word.rstrip(b".,;:!?")
            if bare.isalpha():
                plain_letters.add(bare)
            elif (as_text := bare.decode()).isalpha() and as_text.lower().isalpha():     # one word of letters, then signs: two parts
                (plain_letters if max(as_text) < "\u0250" and as_text.islower() and is_normalized("NFC", as_text) else letters).add(bare)
            else:
                others.append(word)
                continue
            if bare != word:
                ends.append((word, bare, word[len(bare):]))
        others += {e for _, _, e in ends}.difference(self.known, missing)
        if self.bytewise:
            read, known = self.tokenizer.model.tokenize, self.known
            for word in plain_letters.difference(known):
                signs = word.decode("latin-1")
                known[word] = array("I", [t.id for t in read(signs if word.isascii() else signs.translate(BYTE_SIGNS))]).tobytes()
        else:
            letters |= plain_letters
        self._learn_letters([x for x in letters if x not in self.known])
        for word, x in zip(others, self.tokenizer.encode_batch([x.decode() for x in others], add_special_tokens=False)):
            self.known[word] = np.array(x.ids, "<u4").tobytes()
        for word, bare, end in ends:
            self.known[word] = self.known[bare] + self.known[end]

    def _learn_letters(self, new: list[bytes]) -> None:
        for at in range(0, len(new), 20_000):
            part = new[at:at + 20_000]
            x = self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False)
            word = np.array(x.word_ids, np.int64)
            heads = np.flatnonzero(np.diff(word, prepend=-1))
            if len(heads) != len(part):                     # a letter the tokenizer's own pattern does not take as one
                each = [np.array(y.ids, "<u4").tobytes() for y in
                        self.tokenizer.encode_batch([w.decode() for w in part], add_special_tokens=False)]
            else:
                ids, ends = np.array(x.ids, "<u4").tobytes(), [*heads[1:].tolist(), len(word)]
                each = [ids[4 * a:4 * b] for a, b in zip(heads.tolist(), ends)]
            self.known.update(zip(part, each))


def cuts(length: int, capacity: int, slack: int) -> list[int]:
    """Lengths of a document's pieces. A rest stays whole where a bin full of such rests wastes ``slack`` tokens or less."""
    out = [capacity] * (length // capacity)
    rest, part = length % capacity, capacity
    while rest:
        if capacity % rest <= slack or part <= capacity // 16:
            out.append(rest)
            break
        part //= 2
        if rest >= part:
            out.append(part)
            rest -= part
    return out


class Packer:
    """Bins of one task."""

    def __init__(self, capacity: int, task: int, with_ids: bool = True):
        self.capacity, self.next, self.with_ids = capacity, task << 33, with_ids
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def add(self, doc: int | None, start: int, ids: bytes, total: int) -> None:
        size = len(ids) // 4
        share = self.capacity // size
        bin_ = self.open.setdefault(share, [])
        bin_.append((doc, start, size, ids, total))
        if len(bin_) == share:
            self._close(self.open.pop(share))

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, size, ids, total in pieces:
            self.rows.append((doc, start, size, ids if self.with_ids else zlib.crc32(ids), total, self.next, offset))
            offset += size
        self.next += 1

    def finish(self) -> None:
        """Joins the unfinished bins and cuts them: full sequences, then powers of two."""
        pieces = [p for share in sorted(self.open) for p in self.open[share]][::-1]
        self.open = {}
        left = sum(p[2] for p in pieces)
        while left:
            want = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= want
            taken = []
            while want:
                doc, start, size, ids, total = pieces.pop()
                if size > want:
                    pieces.append((doc, start + want, size - want, ids[4 * want:], total))
                    size, ids = want, ids[:4 * want]
                taken.append((doc, start, size, ids, total))
                want -= size
            self._close(taken)

    def drain(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[]] * 7
        self.rows = []
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary() if self.with_ids else pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "start", "length", "ids" if self.with_ids else "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


_TOKENIZERS: dict[str, WordIds] = {}


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, slack: int = 16, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents (``doc_id``, ``text``) with their ids (little-endian unsigned 32-bit; only their crc32, ``ids_crc32``,
    unless ``with_ids``), place in the document and place in a sequence. ``tokenizer``: path of a file for the tokenizers library, the same on all machines."""
    if capacity & (capacity - 1) or capacity < 16:
        raise ValueError("capacity must be a power of two, 16 or more")
    end = int(end_id).to_bytes(4, "little")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _TOKENIZERS:
            _TOKENIZERS[tokenizer] = WordIds(tokenizer)
        words = _TOKENIZERS[tokenizer]
        packer = Packer(capacity, TaskContext.get().partitionId(), with_ids)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                for doc, ids in zip(part.column("doc_id").to_pylist(), words.encode(plain(part.column("text")))):
                    ids += end
                    start, total = 0, len(ids) // 4
                    for size in cuts(total, capacity, slack):
                        packer.add(doc, start, ids[4 * start:4 * (start + size)], total)
                        start += size
                if packer.rows:
                    yield packer.drain()
        packer.finish()
        yield packer.drain()

    return docs.select("doc_id", "text").mapInArrow(task, SCHEMA.format(ids="ids binary" if with_ids else "ids_crc32 bigint"))
