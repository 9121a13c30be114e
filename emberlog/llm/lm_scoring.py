"""Language-model scoring by a hashed maximum-entropy model.

P(word | history) = P(class | history) * P(word | class, history).  Classes partition the words anew for each history: the words that
its n-gram contexts foretell are classes of their own (the most frequent follower of the last two words, that of the skip context
of the last and the third last word, that of the last word), and all other words fall into the fixed classes: the end of a text, the
most frequent words one by one, and clusters of words by their last letters; endings that follow similar endings share a cluster.  The
class softmax is a maximum-entropy model over hashed features of the history: the last word, the last two, the skip features of the
last and third last word and of the second last word alone, and how often and how clearly the contexts foretell a word.  In a class words have their
smoothed shares, without those that the history's own classes have taken, so that all probabilities of a history sum to 1.

Distribution: all tokens are dealt by their last word to blocks of about ``block_tokens``, so that a block holds all that its features
ever see; last words with many tokens are dealt on by the second last word, and pairs of words with many tokens by text and stretches of text (a table of
fixed size has upper bounds of the pairs' counts).  Blocks, hence weights and contexts, grow in number with the corpus.
A block puts its training tokens into an order of their own, so that the result doesn't depend on how rows are dealt to tasks, takes gradient steps over them on its own hashed weights, then scores all its tokens; sums by text come back.  In
training the contexts of a token are counted without it, so that what has been seen once does not foretell itself.

Words that are not among the ``known_words`` most frequent of the training texts share their cluster's rest evenly, with one unit for
words that were never seen.  A word's exact count, for the base score, is the number of training tokens whose last word it is: its block knows.

Words are hashed to 64 bits (two different words share a hash with probability 2**-64); inside blocks contexts and unknown words have 20 to 24 bits of those.

Defined results: a null or empty text has just its end as a token; repeated rows are scored
each on its own; columns other than the id and the text are ignored; an empty table gives an
empty result, and without any training text the classes stay uniform.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashTable, Words, as_long, crc_mod_5, forget, mix, sliced, small_batches, written

END = np.uint64(0x5D588B656C078965)
PAIR, CELL = -1, -2  #: keys of the rows that count pairs of endings, and tokens after pairs of words by cells
ENDINGS, CONTEXTS = 1024, 64
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[np.frombuffer(b".,;:!?\"'()[]{}*#$%&", np.uint8)] = True


@dataclass(frozen=True)
class Settings:
    classes: int = 16  #: fixed classes, 16 at most
    hot_words: int = 4  #: words with a class of their own
    known_words: int = 1 << 18  #: most frequent words, which tasks hold; at most 2**18
    block_tokens: int = 1 << 18
    dealt_tokens: int = 1 << 20  #: tokens that a task holds before it deals them out
    pair_cells: int = 1 << 16  #: of the counts of pairs; where pairs share a cell, they are dealt finer than they need
    step: int = 8192  #: tokens in one gradient step
    rate: float = 0.3


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with an end after each text, ending keys, and the first token of each text."""
    w = Words(texts)
    docs = len(w.first) - 1
    raw = np.concatenate([np.zeros(2, np.uint8), w.raw])
    last = w.stop + 1
    for _ in range(3):
        last = last - (_PUNCTUATION[raw[last]] & (last > w.start + 2))
    ending = raw[last].astype(np.uint64) * np.uint64(257) + raw[last - 1] * (last > w.start + 2)
    first = w.first + np.arange(docs + 1)
    h = np.full(first[-1], END, np.uint64)
    key = np.full(first[-1], ENDINGS, np.int32)
    at = np.arange(len(w.hash)) + w.doc_of()
    h[at] = w.hash
    key[at] = (mix(ending + np.uint64(77)) & np.uint64(ENDINGS - 1)).astype(np.int32)
    return h, key, first


def _back(x: np.ndarray, place: np.ndarray, k: int, none: int) -> np.ndarray:
    """What stands k places before each token in its text, else ``none``."""
    out = np.full_like(x, none)
    out[k:] = x[:-k]
    out[place < k] = none
    return out


def _cell(two: np.ndarray, last: np.ndarray, cells: int) -> np.ndarray:
    return (mix(mix(two) + last) % np.uint64(cells)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    after = np.zeros(cells, np.int64)

    def flush():
        h, key = (np.concatenate(x) for x in zip(*held, strict=True))
        u, at, n = np.unique(h, return_index=True, return_counts=True)
        before, after = key[:-1], key[1:]
        inner = (before < ENDINGS) & (after < ENDINGS)
        pairs = np.bincount(after[inner] * CONTEXTS + before[inner] % CONTEXTS, minlength=0)
        p = np.flatnonzero(pairs)
        yield pa.record_batch(
            {
                "h": np.concatenate([as_long(u), p.astype(np.int64)]),
                "key": np.concatenate([key[at], np.full(len(p), PAIR, np.int32)]),
                "n": np.concatenate([n, pairs[p]]).astype(np.int64),
            }
        )

    for b in sliced(batches):
        h, key, first = _tokens(b["text"])
        place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
        after += np.bincount(_cell(_back(h, place, 2, 0), _back(h, place, 1, 0), cells)[place > 0], minlength=cells)
        held.append((h, key))
        size += len(h)
        if size > 4_000_000:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()
    some = np.flatnonzero(after)
    yield pa.record_batch({"h": some.astype(np.int64), "key": np.full(len(some), CELL, np.int32), "n": after[some]})


class Vocabulary:
    """What all tasks share, of a size that the settings bound: the known words with counts, the classes and their sizes."""

    def __init__(self, settings: Settings, words: np.ndarray, counts: np.ndarray, keys: np.ndarray, pairs: np.ndarray, by_key: np.ndarray, after: np.ndarray):
        """words, counts, keys: the most frequent; pairs: ENDINGS x CONTEXTS; by_key: tokens and types of each key; after: tokens after the pairs of each cell."""
        if END not in words:
            words, counts, keys = np.append(words, END), np.append(counts, np.int64(by_key[0, ENDINGS])), np.append(keys, ENDINGS)
        self.settings, self.words, self.counts = settings, words, counts
        c = settings.classes
        hot = np.flatnonzero(words != END)[: settings.hot_words]
        self.class_of_key = np.append(_clusters(pairs, c - 1 - settings.hot_words) + 1 + settings.hot_words, 0).astype(np.int64)
        self.of_known = self.class_of_key[keys]
        tokens, types = (np.bincount(self.class_of_key, by_key[i], c) for i in (0, 1))
        for i, at in enumerate(hot):
            old = self.of_known[at]
            tokens[old], types[old] = tokens[old] - counts[at], types[old] - 1
            tokens[1 + i], types[1 + i] = counts[at], 1
            self.of_known[at] = 1 + i
        self.alone = 1 + len(hot)  # the classes below have one word each
        self.tokens, self.types = tokens, types
        held = np.bincount(self.of_known, counts + 0.5, c)
        self.size = tokens + 0.5 * (types + 1)  # a unit for words that were never seen
        self.size[: self.alone] = held[: self.alone]
        rare_types = np.maximum(types - np.bincount(self.of_known, minlength=c), 0) + 1
        self.rare_share = np.maximum(self.size - held, 0.5) / rare_types
        self.size = np.where(np.arange(c) < self.alone, self.size, held + self.rare_share * rare_types)
        self.n_tokens, self.n_types = int(by_key[0].sum()), int(by_key[1].sum())
        # held-out texts are about a fourth more
        self.blocks = max(1, -(-self.n_tokens * 5 // (4 * settings.block_tokens)))
        # so many pieces for the tokens after a known word, and one for the starts of texts at the end; small ones, so that blocks of some pieces differ little
        self.pieces = np.append(np.maximum(1, counts * 20 // settings.block_tokens), 1)
        self.pair_pieces = np.where(after * 2 > settings.block_tokens, after * 20 // settings.block_tokens, 1)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def prepare(self) -> None:
        """The look-up table, made once in each Python worker."""
        if not hasattr(self, "known"):
            self.known = HashTable(self.words)

    def codes(self, h: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each word among the known ones, or -1; and 24 bits that tell it: the row, or class and hash."""
        row = self.known.find(h).astype(np.int64)
        rare = self.class_of_key[key] << 20 | (h >> np.uint64(44)).astype(np.int64)  # the class of the end, 0, has no other word
        return row, np.where(row >= 0, row, rare)

    def about(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and share of the words with these codes; of -1, which is none, -1 and 0."""
        c = (code >> 20).astype(np.int32)
        share = np.append(self.rare_share, 0).astype(np.float32)[c]
        known = np.flatnonzero(c == 0)
        c[known], share[known] = self.of_known[code[known]], self.counts[code[known]] + 0.5
        return c, share


def _clusters(pairs: np.ndarray, k: int) -> np.ndarray:
    """k-means over endings by the square roots of what comes before them."""
    share = np.sqrt((pairs + 0.05) / (pairs + 0.05).sum(1, keepdims=True))
    weight = pairs.sum(1) + 1e-3
    order = np.argsort(-weight, kind="stable")
    centres = [share[order[0]]]
    for _ in range(k - 1):  # the next centre is far from the others and frequent
        far = np.min([((share - c) ** 2).sum(1) for c in centres], 0)
        centres.append(share[np.argmax(far * np.sqrt(weight))])
    centre = np.array(centres)
    for _ in range(25):
        near = np.argmin(-2 * share @ centre.T + (centre**2).sum(1), 1)
        total = np.bincount(near, weight, k)
        sums = np.zeros_like(centre)
        np.add.at(sums, near, share * weight[:, None])
        centre = np.where(total[:, None] > 0, sums / np.maximum(total, 1e-9)[:, None], centre)
    return near


def _most_frequent(vocabulary: DataFrame, most: int) -> pd.DataFrame:
    """The frequent words, ``most`` at most: those above the lowest count level that leaves no more.

    Levels are sixteenths of powers of two, so a few hundred numbers tell where to cut, and no task sends
    words that others outdo.
    """
    level = F.floor(F.log2("n") * 16)
    sizes = sorted(vocabulary.groupBy(level.alias("level")).count().collect(), reverse=True)
    low, total = None, 0
    for at, n in sizes:
        total += n
        if total > most:
            break
        low = at
    chosen = vocabulary.filter(level >= low) if low is not None else vocabulary.limit(0)
    return chosen.toPandas().sort_values(["n", "h"], ascending=[False, True])


def vocabulary(docs: DataFrame, settings: Settings = Settings()) -> Vocabulary:
    """Of all rows of ``docs`` (text)."""
    counted = docs.select("text").mapInArrow(lambda batches: _count(batches, settings.pair_cells), "h long, key int, n long").groupBy("h", "key").agg(F.sum("n").alias("n"))
    counted = written(counted, "lm-counts")
    words = counted.filter(F.col("key") >= 0)
    by_key = np.zeros((2, ENDINGS + 1))
    for key, n, types in words.groupBy("key").agg(F.sum("n"), F.count("*")).collect():  # a row for each key at most
        by_key[:, key] = n, types
    pairs = np.zeros(ENDINGS * CONTEXTS)
    for h, n in counted.filter(F.col("key") == PAIR).select("h", "n").collect():
        pairs[h] = n
    after = np.zeros(settings.pair_cells, np.int64)
    for h, n in counted.filter(F.col("key") == CELL).select("h", "n").toLocalIterator():  # a row for each cell at most
        after[h] = n
    top = _most_frequent(words, min(settings.known_words, (1 << 18) - 2))
    forget(counted)
    return Vocabulary(settings, top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), top["key"].to_numpy(np.int64), pairs.reshape(ENDINGS, CONTEXTS), by_key, after)


def _packed(x: np.ndarray, size: int) -> np.ndarray:
    """The low bytes of integers, a row for each."""
    return np.ascontiguousarray(np.ascontiguousarray(x).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size])


def _unpacked(raw: bytes, at: int, n: int, size: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8, n * size, at).reshape(n, size)
    return out.view("<u8").ravel()


_DEALT = pa.schema([("block", pa.int64()), ("batch", pa.int64()), ("at", pa.int64()), ("data", pa.binary())])
_TEXT = np.dtype([("id", "<i8"), ("null", "?"), ("held_out", "?"), ("tokens", "<i8"), ("known", "<i8"), ("base", "<f8")])
_PART = np.dtype([("text", "<u2"), ("score", "<f4")])
_COUNTS = np.dtype([("text", "<u2"), ("known", "<u4"), ("base", "<f8")])


def _deal(shared):
    """Rows of (block, batch, data): tokens of a batch of texts for each block, and what is known of the texts themselves (block < 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        v.prepare()
        task = TaskContext.get()
        batch = (task.partitionId() if task else 0) << 32
        log_known = np.log10(v.counts + 0.5)
        held: list[tuple[np.ndarray, ...]] = []
        texts: list[np.ndarray] = []
        n_tokens = n_texts = 0

        def flush() -> Iterator[pa.RecordBatch]:
            last, row, two, three, code, text, out, block = (np.concatenate(x) for x in zip(*held, strict=True))
            group = (block * 4 + out * 2 + (row < 0)).astype(np.min_scalar_type(4 * v.blocks))  # small integers are sorted faster
            order = np.argsort(group, kind="stable")
            group = group[order].astype(np.int64)
            there = group[np.flatnonzero(np.append(True, group[1:] >> 2 != group[:-1] >> 2))] >> 2  # the blocks that have tokens here
            edges = np.searchsorted(group, there[:, None] * 4 + np.arange(5))
            start = [_packed(np.maximum(row, 0)[order], 3), _packed(last[order], 6)]
            rest = [_packed(x[order], size) for x, size in ((two, 3), (three, 3), (code, 3), (text, 2))]
            data, blocks = [np.concatenate(texts).tobytes()], [-1 - batch % 1009]
            for k, e in zip(there.tolist(), edges, strict=True):
                data.append(np.diff(e).astype("<u4").tobytes() + b"".join(start[i % 2][a:b].tobytes() for i, (a, b) in enumerate(zip(e[:-1].tolist(), e[1:].tolist(), strict=True))) + b"".join(x[e[0] : e[4]].tobytes() for x in rest))
                blocks.append(k)
            yield pa.record_batch([pa.array(blocks, pa.int64()), pa.array(np.full(len(blocks), batch)), pa.array(np.zeros(len(blocks), np.int64)), pa.array(data, pa.binary())], schema=_DEALT)

        for b in (x.slice(at, 50_000) for x in sliced(batches, 1 << 20) for at in range(0, len(x), 50_000)):  # a text's number in its batch has 16 bits
            h, key, first = _tokens(b["text"])
            n = np.diff(first)
            row, code = v.codes(h, key)
            ids = b["doc_id"].fill_null(0).to_numpy()
            text = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(h)) - first[text]

            last, two, three = (_back(h, place, k, 0) for k in (1, 2, 3))
            # the starts of texts count as after a word of their own
            last_row = np.where(place == 0, len(v.words), _back(row, place, 1, 0))
            pieces = v.pieces[np.where(last_row >= 0, last_row, len(v.words))].astype(np.uint64)
            own = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(1))[text]
            split = v.pair_pieces[_cell(two, last, len(v.pair_pieces))].astype(np.uint64)
            stretch = mix(own + (place >> 10).astype(np.uint64)) % split
            # pieces of a pair, and of a word, go to different blocks in turn
            piece = (mix(two) % pieces + stretch) % pieces
            block = (np.where(place == 0, own, mix(last) % np.uint64(v.blocks) + piece) % np.uint64(v.blocks)).astype(np.int64)
            out = b["held_out"].to_numpy(zero_copy_only=False).astype(np.int64)
            if held and n_texts + len(n) > 60_000:
                yield from flush()
                held, texts, n_tokens, n_texts, batch = [], [], 0, 0, batch + 1
            held.append((last, last_row, two >> np.uint64(40), three >> np.uint64(40), code, text + n_texts, out[text], block))
            about = np.zeros(len(n), _TEXT)
            about["id"], about["null"], about["held_out"], about["tokens"] = ids, b["doc_id"].is_null().to_numpy(zero_copy_only=False), out > 0, n
            known = (np.append(v.counts, 0)[row] > 0).astype(np.int64)  # -1 takes the zero
            about["known"] = np.add.reduceat(known, first[:-1])  # each text has its end, so no slice is empty
            about["base"] = np.add.reduceat(np.append(log_known, 0.0)[row], first[:-1])
            texts.append(about)
            n_tokens, n_texts = n_tokens + len(h), n_texts + len(n)
            if n_tokens >= v.settings.dealt_tokens:
                yield from flush()
                held, texts, n_tokens, n_texts, batch = [], [], 0, 0, batch + 1
        if held:
            yield from flush()

    return run


def _numbered(x: np.ndarray) -> tuple[np.ndarray, int]:
    u, at = np.unique(x, return_inverse=True)
    return at.astype(np.int32), len(u)


class Followers:
    """For each context of a block: how many training tokens it has, and its two most frequent words with their counts."""

    def __init__(self, context: np.ndarray, contexts: int, code: np.ndarray, train: int):
        """The first ``train`` tokens are those for training."""
        self.n = np.bincount(context[:train], minlength=contexts).astype(np.int32)
        self.word, self.count = np.full((2, contexts), -1, np.int32), np.zeros((2, contexts), np.int32)
        if not train:
            return
        runs = np.sort(context[:train].astype(np.int64) << 24 | code[:train])
        first = np.flatnonzero(np.append(True, runs[1:] != runs[:-1]))
        runs, count = runs[first], np.diff(np.append(first, train))
        of = runs >> 24
        value = count << 24 | (runs & 0xFFFFFF)
        edge = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        there = of[edge]
        for k in (0, 1):
            best = np.maximum.reduceat(value, edge)
            some = best > 0
            self.word[k, there[some]], self.count[k, there[some]] = best[some] & 0xFFFFFF, best[some] >> 24
            value[value == np.repeat(best, np.diff(np.append(edge, len(of))))] = 0

    def foretold(self, context: np.ndarray, code: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``words``, how sure it is: 0 to 7) for tokens of these contexts; with ``code`` each token is left out of its own context."""
        n, count, size = self.n[context], self.count[0, context], self.word.shape[1]
        at = context
        if code is not None:
            less = self.count[1, context]
            own = self.word[0, context] == code
            n, count = n - 1, count - own
            second = own & (less > count)
            at, count = context + second * size, np.where(second, less, count)
        return np.where(count > 0, at, 2 * size), _SURENESS[np.minimum(n, 8) * 11 + count * 10 // np.maximum(n, 1)]

    def words(self) -> np.ndarray:
        """The most frequent word of each context, then the next, then -1 for none."""
        return np.append(self.word.ravel(), -1)


def _sureness() -> np.ndarray:
    """By the number of tokens, up to 8, and the tenths of them that have the word."""
    n, tenths = np.divmod(np.arange(99), 11)
    return np.select([n <= 0, n == 1, (n == 2) & (tenths < 10), n == 2, tenths < 3, tenths < 7, (n < 8) | (tenths < 9)], np.arange(7), 7).astype(np.int32)


_SURENESS = _sureness()


class Block:
    """The tokens of a block, training tokens first, and the model that they make."""

    def __init__(self, v: Vocabulary, last: np.ndarray, two: np.ndarray, three: np.ndarray, code: np.ndarray, train: int):
        """last: a number for each last word; two, three: 24 bits of the words before; code: that of the word itself."""
        self.v, self.code, self.train = v, code.astype(np.int32), train
        pair, skip = (last.astype(np.uint64) << np.uint64(24) | x for x in (two, three))
        self.context = []
        self.followers = []
        for x in (pair, skip, last):
            at, n = _numbered(x)
            self.context.append(at)
            self.followers.append(Followers(at, n, self.code, train))
        kept = sum(int(np.count_nonzero(f.n > 1)) for f in self.followers)
        bits = max(8, int(np.ceil(np.log2(2 * kept + 1))))
        rows = []
        for kind, (x, at, f) in enumerate(zip((pair, skip, last.astype(np.uint64)), self.context, self.followers, strict=True)):
            hashed = (mix(x * np.uint64(8) + np.uint64(kind + 1)) >> np.uint64(64 - bits)).astype(np.int32) + _SURE
            rows.append(np.where(f.n[at] > 1, hashed, _SURE + (1 << bits)))  # contexts that were seen once have the last row, which stays zero
        rows.append((mix(two.astype(np.uint64) * np.uint64(8) + np.uint64(5)) >> np.uint64(64 - bits)).astype(np.int32) + _SURE)
        self.rows = rows
        self.classes = v.settings.classes
        self.width = len(self.followers) + self.classes
        self.weights = np.zeros((_SURE + (1 << bits) + 1, self.width), np.float32)
        self.bias = np.zeros(self.width, np.float32)
        self.words = [(w := f.words(), *v.about(w)) for f in self.followers]

    def part(self, at: slice, learning: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the tokens of a slice: rows of the weights, classes that can't be, their class, and log10 P(word | class, history)."""
        v, code = self.v, self.code[at]
        n, k = len(code), len(self.followers)
        out = np.zeros((n, self.width), bool)
        own, share = v.about(code)
        label, taken = own + k, np.zeros(n, np.float32)
        level = np.zeros(n, np.int32)
        earlier: list[np.ndarray] = []
        for i, (f, context, (words, classes, shares)) in enumerate(zip(self.followers, self.context, self.words, strict=True)):
            place, sure = f.foretold(context[at], code if learning else None)
            level = level * 8 + sure
            for word in earlier:
                place = np.where(words[place] == word, len(words) - 1, place)
            word = words[place]
            earlier.append(word)
            out[:, i] = word < 0
            c = classes[place]
            lone = np.flatnonzero((c >= 0) & (c < v.alone))
            out[lone, k + c[lone]] = True
            taken += shares[place] * (c == own)
            label = np.where((word == code) & (label >= k), i, label)
        rows = np.stack([level, *[r[at] for r in self.rows]])
        rest = np.maximum(v.size.astype(np.float32)[own] - taken, np.float32(1e-9))
        inside = np.where(label < k, 0.0, np.log10(share / rest))
        return rows, out, label, np.minimum(inside, 0)

    def chances(self, rows: np.ndarray, out: np.ndarray) -> np.ndarray:
        """P(class | history)."""
        x = self.weights.take(rows[0], 0)
        for r in rows[1:]:
            x += self.weights.take(r, 0)
        x += self.bias
        np.minimum(x, 60, out=x)  # the weights stay far from where exp would overflow, and are held there
        np.exp(x, out=x)
        x *= ~out
        x /= (x @ np.ones(self.width, np.float32))[:, None]
        return x

    def learn(self) -> None:
        step, rate = self.v.settings.step, self.v.settings.rate
        square = np.zeros(len(self.weights), np.float32)
        prior = np.append(np.full(len(self.followers), self.train * 0.1 + 1), self.v.tokens / max(self.v.tokens.sum(), 1) * self.train + 1)
        self.bias[:] = np.log(prior / prior.sum())
        for start in range(0, self.train, step):
            rows, out, label, _ = self.part(slice(start, min(start + step, self.train)), True)
            g = self.chances(rows, out)
            g[np.arange(len(label)), label] -= 1
            flat = rows.ravel()
            at = np.flatnonzero(flat != len(self.weights) - 1)
            at = at[np.argsort(flat[at], kind="stable")]
            flat = flat[at]
            first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
            total = np.add.reduceat(g[at % len(label)], first, axis=0)
            u = flat[first]
            square[u] += np.einsum("ij,ij->i", total, total)
            self.weights[u] -= total * (3 * rate / np.sqrt(square[u] + 1))[:, None]

    def score(self) -> np.ndarray:
        """log10 of the probability of each token."""
        step = self.v.settings.step
        out = []
        for start in range(0, len(self.code), step):
            rows, no, label, inside = self.part(slice(start, start + step), False)
            p = self.chances(rows, no)[np.arange(len(label)), label]
            out.append(np.log10(np.maximum(p, 1e-30)) + inside)
        return np.concatenate(out)


_SURE = 512  #: rows of the weights for how sure the three contexts are


def _read(batches: list[bytes]) -> tuple[dict[str, np.ndarray], int, np.ndarray]:
    """The tokens of a block out of its batches, training tokens first; how many those are; and the batch of each."""
    names = ("last", "two", "three", "code", "text")
    groups: list[list[tuple[np.ndarray, ...]]] = [[], []]
    for number, raw in enumerate(batches):
        n = np.frombuffer(raw, "<u4", 4).astype(np.int64)
        at, last = 16, []
        for i, k in enumerate(n.tolist()):
            last.append(_unpacked(raw, at, k, 3 if i % 2 == 0 else 6) | np.uint64(0 if i % 2 == 0 else 1 << 63))
            at += k * (3 if i % 2 == 0 else 6)
        columns = [np.concatenate(last)]
        for size in (3, 3, 3, 2):
            columns.append(_unpacked(raw, at, int(n.sum()), size))
            at += int(n.sum()) * size
        columns.append(np.full(int(n.sum()), number, np.uint64))
        cut = int(n[:2].sum())
        groups[0].append(tuple(x[:cut] for x in columns))
        groups[1].append(tuple(x[cut:] for x in columns))
    all_ = [np.concatenate(x) for x in zip(*groups[0], *groups[1], strict=True)]
    return dict(zip(names, all_[:5], strict=True)), sum(len(g[0]) for g in groups[0]), all_[5].astype(np.int64)


def _scored_block(v: Vocabulary, block: list[tuple[int, bytes]]) -> pa.RecordBatch:
    """Sums by text of what a block knows: the model's score, and counts of the words that aren't known."""
    x, train, batch = _read([data for _, data in block])
    # an order that depends on the tokens alone; those that are alike may change places
    own = np.argsort(mix(mix(mix(x["last"]) + x["two"]) + (x["three"] << np.uint64(24)) + x["code"])[:train], kind="stable")
    own = np.append(own, np.arange(train, len(batch)))
    x, batch = {k: c[own] for k, c in x.items()}, batch[own]
    rare = x["last"] >> np.uint64(63) > 0
    last, lasts = _numbered(x["last"])
    model = Block(v, last, x["two"], x["three"], x["code"].astype(np.int64), train)
    model.learn()
    score = model.score()
    seen = np.bincount(last[:train], minlength=lasts)[last]
    text = batch << 16 | x["text"].astype(np.int64)
    u, at = np.unique(text, return_inverse=True)
    part = np.zeros(len(u), _PART)
    part["text"], part["score"] = u & 0xFFFF, np.bincount(at, score)
    some = np.bincount(at, rare) > 0
    counts = np.zeros(len(u), _COUNTS)
    counts["text"], counts["known"] = u & 0xFFFF, np.bincount(at, rare & (seen > 0))
    counts["base"] = np.bincount(at, np.where(rare, np.log10(seen + 0.5), 0))
    data, batches = [], []
    edges = np.searchsorted(u >> 16, np.arange(len(block) + 1))
    for number, (name, _) in enumerate(block):
        own = slice(edges[number], edges[number + 1])
        data.append(np.uint32(own.stop - own.start).tobytes() + part[own].tobytes() + counts[own][some[own]].tobytes())
        batches.append(name)
    return pa.record_batch([pa.array(np.zeros(len(data), np.int64)), pa.array(batches, pa.int64()), pa.array(np.ones(len(data), np.int64)), pa.array(data, pa.binary())], schema=_DEALT)


def _learn_and_score(shared):
    """Rows come sorted by block; those of texts (block < 0) pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        held: list[tuple[int, bytes]] = []
        now = None
        for b in batches:
            through = [i for i, block in enumerate(b["block"].to_pylist()) if block < 0]
            if through:
                yield b.take(pa.array(through))
            for i in range(len(through), len(b)):  # negative blocks come first
                block = b["block"][i].as_py()
                if block != now and held:
                    yield _scored_block(v, held)
                    held = []
                now = block
                held.append((b["batch"][i].as_py(), b["data"][i].as_py()))
        if held:
            yield _scored_block(v, held)

    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, counts double, score double"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by batch, that of its texts first."""
    texts: np.ndarray | None = None
    score: np.ndarray | None = None

    def done() -> pa.RecordBatch:
        return pa.record_batch(
            {
                "doc_id": pa.array(texts["id"], mask=texts["null"]), "held_out": texts["held_out"], "n_tokens": texts["tokens"], "n_known": texts["known"],
                "counts": texts["base"], "score": score,
            }
        )

    for b in batches:
        for kind, data in zip(b["at"].to_pylist(), b["data"].to_pylist(), strict=True):
            if kind == 0:
                if texts is not None:
                    yield done()
                texts = np.frombuffer(data, _TEXT).copy()
                score = np.zeros(len(texts))
            else:
                n = int(np.frombuffer(data, "<u4", 1)[0])
                part = np.frombuffer(data, _PART, n, 4)
                counts = np.frombuffer(data, _COUNTS, -1, 4 + n * _PART.itemsize)
                score[part["text"]] += part["score"]
                texts["known"][counts["text"]] += counts["known"]
                texts["base"][counts["text"]] += counts["base"]
    if texts is not None:
        yield done()


def score(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Scores the text of every row; trains on those whose crc32 of the id modulo 5 isn't 1.

    ``gain``: by how much the model's log10 probability of a token beats the base on average.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("held_out", crc_mod_5(docs["doc_id"]) == 1)
    v = vocabulary(docs.filter(~F.col("held_out")), settings)
    shared = docs.sparkSession.sparkContext.broadcast(v)  # of a size that the settings bound
    schema = "block long, batch long, at long, data binary"
    dealt = docs.mapInArrow(_deal(shared), schema).repartition("block").sortWithinPartitions("block")
    parts = dealt.mapInArrow(_learn_and_score(shared), schema).repartition("batch").sortWithinPartitions("batch", "at")
    scored = parts.mapInArrow(_summed, _SCORED)
    base = F.col("counts") - F.col("n_tokens") * F.lit(float(np.log10(v.n_tokens + 0.5 * (v.n_types + 1))))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(v.n_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score", ((F.col("score") - base) / F.col("n_tokens")).alias("gain")
    )
