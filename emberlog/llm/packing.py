"""Packing of documents into sequences, hierarchically over several context sizes.

Every document becomes its tokens and an end token.  Whole windows of the longest context are
cut off first and the rest is routed to the shortest tier that holds it.  Tiers are packed from
the longest to the shortest: a window opens with the longest rest of its tier, its gap is filled
with the longest rests of shorter tiers that fit, and the last gap with a piece cut from a
shorter rest (or from its own tier if none is shorter).  So windows of every tier are full, and
only the last window of a task is padded.  Windows of a tier are dealt to step groups of equal
token numbers.

A task packs the documents that it reads, by blocks of bounded size, without a shuffle; what
is left of a block goes to the next one.  Sequence numbers have the task's number in the upper
32 bits.

With the tokenizer that folds case and drops white space, words are tokenised once per cache: white space always ends a token, so a
text's tokens are those of its words in a row.  Words that hold a special token in any letter case are encoded as they stand, as special
tokens are told before case is folded.  Any other tokenizer encodes whole texts.

Defined results: a null or empty text is its end token; repeated rows and ids are packed each
on its own; columns other than id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced


@dataclass(frozen=True)
class Settings:
    tiers: tuple[int, ...] = (256, 512, 1024, 2048, 4096)  #: powers of two, ascending
    step_tokens: int = 65536
    tokenizer: str = "word_bpe_49k.json"  #: a file of public_tokenizers, or a path
    end_id: int = 2
    block_tokens: int = 8_000_000
    cached_words: int = 240_000


#: The tokenizer whose words are independent: these must be its normalizer and its pre-tokenizer.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [_SPLIT, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"


class Tokens:
    """Token ids of texts as little-endian 32-bit numbers, word by word with a bounded cache.

    The cache has two generations: when the younger is full it becomes the older one, from which words that
    come again are taken over.
    """

    #: Letters that normalisation leaves as they are, then marks that no special token has: one run of each, and so a piece of each.
    _FORM = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:;=?@\[-`{}~]*)")

    def __init__(self, settings: Settings):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        path = settings.tokenizer if os.path.exists(settings.tokenizer) else public_tokenizers.path(settings.tokenizer)
        self.tokenizer = Tokenizer.from_file(path)
        shape = json.loads(self.tokenizer.to_str())
        added = shape["added_tokens"]
        #: Special tokens inside words only, and words on their own: else texts are encoded whole.
        self.by_words = (
            (shape["normalizer"], shape["pre_tokenizer"]) == (_NORMALIZER, _PRE_TOKENIZER)
            and shape["model"]["end_of_word_suffix"] == "</w>"
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or t["content"].split() != [t["content"]] for t in added)
        )
        self.special = [t["content"].lower().encode() for t in added]
        self.model = self.tokenizer.model
        self.most = max(1, settings.cached_words // 2)
        self.end = settings.end_id.to_bytes(4, "little")
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.id_bytes = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values()) + 1)]
        # byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.letter = {b: 256 + i for i, b in enumerate(rest)}

    def _piece(self, piece: bytes) -> bytes:
        """A run of letters or of marks: the model's own step is all there is."""
        text = piece.decode() if piece.isascii() else piece.decode("latin-1").translate(self.letter)
        return b"".join([self.id_bytes[t.id] for t in self.model.tokenize(text)])

    def _part(self, piece: bytes) -> bytes:
        got = self.cache.get(piece) or self.older.get(piece) or self._piece(piece)
        self.cache[piece] = got
        return got

    def _learn(self, word: bytes) -> bytes:
        got = self.cache.get(word) or self.older.get(word)
        if got is None:
            if word.isalpha():  # of bytes: ASCII alone
                got = self._piece(word)
            elif form := self._FORM.fullmatch(word.decode()):
                letters, marks = form[1].encode(), form[2].encode()
                got = self._part(letters) + self._part(marks) if marks else self._piece(letters)
            else:
                got = self._whole(word.decode())
        self.cache[word] = got
        return got

    def _whole(self, text: str) -> bytes:
        return b"".join([self.id_bytes[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def of(self, text: str | None) -> bytes:
        """The ids of the text and the end."""
        if not self.by_words:
            return self._whole(text or "") + self.end
        if len(self.cache) > self.most:
            self.cache, self.older = {}, self.cache
        raw = (text or "").encode()
        low = raw.lower()
        words = low.split()
        parts, at = list(map(self.cache.get, words)), 0
        if any(t in low for t in self.special):
            for i, word in enumerate(raw.split()):
                if any(t in words[i] for t in self.special):
                    parts[i] = self._whole(word.decode())
        for _ in range(parts.count(None)):
            at = parts.index(None, at)
            parts[at] = self._learn(words[at])
        return b"".join(parts) + self.end


@lru_cache(maxsize=1)
def tokens_of(settings: Settings) -> Tokens:
    """One for each Python worker, whose tasks share the cache."""
    return Tokens(settings)


class Packer:
    """Packs pieces (length, number, start) of a block; what doesn't fill a window stays in ``rests``."""

    def __init__(self, settings: Settings):
        self.tiers, self.longest = settings.tiers, settings.tiers[-1]
        self.rests: list[tuple[int, int, int]] = []  # ascending

    def whole(self, number: int, length: int) -> list[list[tuple[int, int, int]]]:
        """Windows of the longest context out of one document; keeps its rest."""
        full = length // self.longest
        if length % self.longest:
            insort(self.rests, (length % self.longest, number, full * self.longest))
        return [[(self.longest, number, i * self.longest)] for i in range(full)]

    def windows(self) -> Iterator[list[tuple[int, int, int]]]:
        """Full windows out of the rests, the longest tier first."""
        for tier, below in zip(reversed(self.tiers), [*reversed(self.tiers[:-1]), 0], strict=True):
            while self.rests and self.rests[-1][0] > below:
                window, gap = [self.rests.pop()], 0
                gap = tier - window[0][0]
                while gap and self.rests:
                    at = bisect_right(self.rests, (gap, 1 << 62, 0)) - 1
                    if at >= 0:
                        piece = self.rests.pop(at)
                    else:  # all are longer than the gap: cut the shortest
                        length, number, start = self.rests.pop(0)
                        piece = (gap, number, start)
                        insort(self.rests, (length - gap, number, start + gap))
                    window.append(piece)
                    gap -= piece[0]
                if gap:
                    for piece in window:
                        insort(self.rests, piece)
                    return
                yield window

    def last(self) -> list[tuple[int, int, int]]:
        """What is left: less than a window."""
        out, self.rests = self.rests, []
        return out


def _pack(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = tokens_of(settings), Packer(settings)
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 32
        made, by_tier = 0, dict.fromkeys(settings.tiers, 0)
        held: dict[int, tuple[int | None, bytes]] = {}
        number = 0

        def rows(windows) -> Iterator[pa.RecordBatch]:
            nonlocal made
            out = []
            for window in windows:
                total = sum(p[0] for p in window)
                tier = next(t for t in settings.tiers if t >= total)
                group = base + (settings.tiers.index(tier) << 28) + by_tier[tier] * tier // settings.step_tokens
                by_tier[tier] += 1
                offset = 0
                for length, doc, start in window:
                    doc_id, ids = held[doc]
                    out.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, base + made, offset, tier, group))
                    offset += length
                made += 1
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])

        size, full = 0, []
        for b in sliced(batches):
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                ids = tokens.of(text)
                held[number] = doc_id, ids
                full += packer.whole(number, len(ids) // 4)
                number += 1
                size += len(ids) // 4
                if size >= settings.block_tokens:
                    yield from rows([*full, *packer.windows()])
                    left = {p[1] for p in packer.rests}
                    held = {k: v for k, v in held.items() if k in left}
                    size, full = 0, []
        yield from rows([*full, *packer.windows()])
        if packer.rests:
            yield from rows([packer.last()])

    return run


def pack(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each piece of a document, with its place in a sequence."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pack(settings), SCHEMA)
