"""BPE encoding and decoding with a word-end vocabulary, in batched numpy merge rounds.

Texts are normalised (NFC, lower case) and cut into words; each distinct word of a batch is encoded once. The
symbols of all those words lie in one flat array. A round looks up every neighbouring pair by binary search over
the sorted pair keys, takes each word's lowest rank, merges all its occurrences from the left, and lets finished
words leave. Words of more than LONG_WORD bytes would take a round for almost every merge; their pairs wait in a heap
by rank and place instead, which gives the same merges. Memory is bounded by the batch and by the word cache, which
is emptied when it is full.

Letters, digits, cases and combining marks are those of the tokenizers library, which the driver asks once about every
code point; the few of which Python's own modules know something else take a path of their own.

Null text counts as empty: no ids, an empty decoded text. Repeated rows give repeated results; row order and
extra input columns do not matter.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import ship_by_value, text_slices

#: Bytes of text encoded at once, and words the cache may hold.
BATCH_BYTES, CACHE_WORDS = 1 << 19, 150_000
#: Bytes of the longest word that is merged in rounds.
LONG_WORD = 256
#: The vocabulary's own word pattern, its classes left open, and its white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{digit}]|[^{space}{letter}{digit}]+"
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Code points asked about at once.
POINTS = 1 << 13
NO_RANK = np.int64(1 << 62)


class Classes(NamedTuple):
    """What the tokenizers library knows of characters; texts are the insides of regular expression classes."""

    letter: str
    digit: str
    starter: str  # marks and second halves that its NFC leaves where they are, as it knows an older Unicode
    lower: dict[int, str]  # lower cases that Python does not know
    odd: str  # all code points of which Python's modules know something else
    hint: str  # those of the basic plane and all beyond it: few ranges, so a search is quick


class Vocabulary(NamedTuple):
    """What executors get once, by broadcast; its size is the vocabulary's."""

    tokens: list[str]
    keys: np.ndarray  # sorted left * len(tokens) + right
    ranks: np.ndarray  # of keys
    merged: np.ndarray  # of keys
    inner: np.ndarray  # symbol of a byte
    last: np.ndarray  # symbol of a byte that ends its word
    special: dict[str, int]
    classes: Classes


def _inside(known: np.ndarray) -> str:
    """The inside of a class of the code points that known marks, by ranges; none at all gives a surrogate, which no text has."""
    points = np.flatnonzero(known) if known.any() else np.array([0xD800])
    cut = np.flatnonzero(np.diff(points) != 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(points[np.r_[0, cut + 1]].tolist(), points[np.r_[cut, len(points) - 1]].tolist(), strict=True))


def library_classes() -> Classes:
    """Asked in blocks of code points, as the library keeps an alignment of every character that it is given."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    letter, digit, starter, odd = (np.zeros(0x110000, bool) for _ in range(4))
    lower: dict[int, str] = {}
    kinds = [(known, pre_tokenizers.Split(Regex(p), "removed", invert=True), regex.compile(p)) for known, p in ((letter, r"\p{L}"), (digit, r"\p{N}"))]
    nfc, nfd, low = normalizers.NFC(), normalizers.NFD(), normalizers.Lowercase()
    marks = "\u0327\u0301"  # a mark between a letter and these changes their order or bars their composition

    def each(normalizer: normalizers.Normalizer, texts: list[str]) -> list[str]:
        return normalizer.normalize_str("\n".join(texts)).split("\n")

    for start in range(0, 0x110000, POINTS):
        chars = [chr(c) for c in range(start, start + POINTS) if not 0xD800 <= c < 0xE000 and c != ord("\n")]
        if not chars:
            continue
        text = "".join(chars)
        for known, split, ours in kinds:
            mine = np.zeros(POINTS, bool)
            mine[[ord(c) - start for c in ours.findall(text)]] = True
            known[[ord(c) for run, _ in split.pre_tokenize_str(text) for c in run]] = True
            odd[start : start + POINTS] |= mine != known[start : start + POINTS]
        lower |= {ord(c): got for c, got in zip(chars, each(low, chars), strict=True) if got != c.replace("Σ", "σ").lower()}
        framed = ["a" + c + marks for c in chars]
        starter[[ord(c) for c, f, got in zip(chars, framed, each(nfc, framed), strict=True) if got != unicodedata.normalize("NFC", f)]] = True
        starter[[ord(unicodedata.normalize("NFD", c)[-1]) for c, got in zip(chars, each(nfd, chars), strict=True) if got != unicodedata.normalize("NFD", c)]] = True
    odd |= starter
    odd[list(lower)] = True
    hint = odd[:0x10000].copy()
    return Classes(_inside(letter), _inside(digit), _inside(starter), lower, _inside(odd), _inside(hint) + r"\U00010000-\U0010ffff")


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(spare)) for b in range(256)]


def load_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [""] * (max([*vocab.values(), *special.values()]) + 1)
    for token, i in [*vocab.items(), *special.items()]:
        tokens[i] = token
    pairs = [(vocab[a] * len(tokens) + vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(spec["model"]["merges"])]
    keys, ranks, merged = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    order = np.argsort(keys)
    chars = _byte_chars()
    inner, last = (np.array([vocab[c + end] for c in chars], np.int64) for end in ("", suffix))
    return Vocabulary(tokens, keys[order], ranks[order], merged[order], inner, last, special, library_classes())


def encode_words(vocab: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All words' ids in one array, and len(words) + 1 offsets into it."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    symbol = vocab.inner[np.frombuffer(b"".join(words), np.uint8)]
    ends = np.cumsum(sizes)[sizes > 0]
    symbol[ends - 1] = vocab.last[np.frombuffer(b"".join(w[-1:] for w in words), np.uint8)]
    word = np.repeat(np.arange(len(words)), sizes)
    done_symbols, done_words = [symbol[:0]], [word[:0]]
    base = len(vocab.tokens)
    while len(symbol):
        key = symbol[:-1] * base + symbol[1:]
        at = np.minimum(np.searchsorted(vocab.keys, key), len(vocab.keys) - 1)
        rank = np.full(len(symbol), NO_RANK)
        hit = np.flatnonzero((vocab.keys[at] == key) & (word[:-1] == word[1:]))
        rank[hit] = vocab.ranks[at[hit]]
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(word)]))
        best = np.flatnonzero((rank == least) & (least < NO_RANK))
        # of overlapping occurrences (a pair of equal symbols in a row) every second one merges, from the left
        run = np.maximum.accumulate(np.where(np.r_[True, np.diff(best) != 1], np.arange(len(best)), 0)) if len(best) else best
        best = best[(np.arange(len(best)) - run) % 2 == 0]
        symbol[best] = vocab.merged[at[best]]
        open_ = least < NO_RANK
        done_symbols.append(symbol[~open_])
        done_words.append(word[~open_])
        open_[best + 1] = False
        symbol, word = symbol[open_], word[open_]
    word = np.concatenate(done_words)
    order = np.argsort(word, kind="stable")
    return np.concatenate(done_symbols)[order], np.r_[0, np.cumsum(np.bincount(word, minlength=len(words)))]


def encode_long_word(vocab: Vocabulary, word: bytes) -> np.ndarray:
    """The ids of one word: always the pair of least rank, of equal ones the leftmost, merges."""
    symbol = vocab.inner[np.frombuffer(word, np.uint8)]
    symbol[-1] = vocab.last[word[-1]]
    base = len(vocab.tokens)

    def found(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(vocab.keys, keys), len(vocab.keys) - 1)
        return at, vocab.keys[at] == keys

    at, hit = found(symbol[:-1] * base + symbol[1:])
    waiting = [(int(vocab.ranks[at[i]]), i, int(at[i])) for i in np.flatnonzero(hit).tolist()]
    heapq.heapify(waiting)
    symbols, after, before = symbol.tolist(), [*range(1, len(symbol)), -1], [*range(-1, len(symbol) - 1)]
    keys, ranks = vocab.keys, vocab.ranks

    def push(left: int, right: int) -> None:
        key = symbols[left] * base + symbols[right]
        k = int(np.searchsorted(keys, key))
        if k < len(keys) and keys[k] == key:
            heapq.heappush(waiting, (int(ranks[k]), left, k))

    while waiting:
        _, left, k = heapq.heappop(waiting)
        right = after[left]
        if right < 0 or symbols[left] < 0 or symbols[left] * base + symbols[right] != keys[k]:
            continue  # one of its symbols has merged since
        symbols[left], symbols[right] = int(vocab.merged[k]), -1
        after[left] = after[right]
        if after[left] >= 0:
            before[after[left]] = left
            push(left, after[left])
        if before[left] >= 0:
            push(before[left], left)
    return np.array([x for x in symbols if x >= 0], np.int64)


def decode_ids(vocab: Vocabulary, ids: np.ndarray) -> str:
    """The vocabulary names no decoder, so its tokens are joined by spaces, special ones included."""
    return " ".join([vocab.tokens[i] for i in ids.tolist()])


class Encoder:
    """Encodes texts, remembering the words met so far."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.words = regex.compile(WORD_PATTERN.format(letter=r"\p{L}", digit=r"\p{N}", space=SPACE))
        self.exact_words = re.compile(WORD_PATTERN.format(letter=vocab.classes.letter, digit=vocab.classes.digit, space=SPACE))
        self.hint, self.odd, self.starter = re.compile(f"[{vocab.classes.hint}]"), re.compile(f"[{vocab.classes.odd}]"), re.compile(f"([{vocab.classes.starter}])")
        self.ascii_words = re.compile(WORD_PATTERN.format(letter="a-z", digit="0-9", space=SPACE))
        self.special = re.compile("|".join(map(re.escape, sorted(vocab.special, key=len, reverse=True))) or r"(?!)")
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.offsets, self.decoded = np.zeros(0, np.int64), np.zeros(1, np.int64), []

    def _split(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_words.findall(text.lower())
        if self.hint.search(text) and self.odd.search(text):
            text = "".join([unicodedata.normalize("NFC", part) for part in self.starter.split(text)])
            return self.exact_words.findall(text.translate(self.vocab.classes.lower).replace("Σ", "σ").lower())
        # one character at a time there is no final sigma, which str.lower() knows
        return self.words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def split(self, text: str) -> list[str]:
        if "<|" not in text:
            return self._split(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self._split(text[at : m.start()])
            out.append("\0" + m[0])  # no word holds both a NUL and letters
            at = m.end()
        return out + self._split(text[at:])

    def _learn(self, words: list[str]) -> None:
        encoded = [w.encode() for w in words]
        ids, offsets = encode_words(self.vocab, [w if len(w) <= LONG_WORD else b"" for w in encoded])
        if any(len(w) > LONG_WORD for w in encoded):
            parts = [encode_long_word(self.vocab, w) if len(w) > LONG_WORD else ids[a:b] for w, a, b in zip(encoded, offsets[:-1], offsets[1:], strict=True)]
            ids, offsets = np.concatenate(parts), np.r_[0, np.cumsum([len(x) for x in parts])]
        for k, w in enumerate(words):
            if w[0] == "\0" and w[1:] in self.vocab.special:
                ids[offsets[k]] = self.vocab.special[w[1:]]
                ids[offsets[k] + 1 : offsets[k + 1]] = -1
        keep = ids >= 0
        offsets = np.r_[0, np.cumsum(keep)][offsets]
        ids = ids[keep]
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words)), strict=True))
        self.decoded += [decode_ids(self.vocab, ids[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        self.ids, self.offsets = np.concatenate([self.ids, ids]), np.concatenate([self.offsets, offsets[1:] + self.offsets[-1]])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """All ids as unsigned 32-bit integers, len(texts) + 1 offsets into them, and each text's decoded form."""
        split = [self.split(t) for t in texts]
        flat = [w for words in split for w in words]
        if len(self.index) > CACHE_WORDS:
            self.forget()
        if new := sorted({*flat} - self.index.keys()):
            self._learn(new)
        which = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        start, size = self.offsets[which], self.offsets[which + 1] - self.offsets[which]
        total = np.r_[0, np.cumsum(size)]
        ids = self.ids[np.repeat(start - total[:-1], size) + np.arange(total[-1])].astype("<u4")
        decoded, at = [], 0
        joined = self.decoded
        where = which.tolist()
        ends = np.r_[0, np.cumsum([len(w) for w in split])].astype(np.int64)
        for at, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            decoded.append(" ".join([joined[i] for i in where[at:end]]))
        return ids, total[ends], decoded


def bpe(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, ids (binary: unsigned 32-bit integers, little-endian), n_tokens long, decoded string.

    vocabulary is the path of the vocabulary file on the driver.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(vocabulary))
    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for a, b in text_slices(batch.column(1), BATCH_BYTES):
                ids, offsets, decoded = encoder.encode(batch.column(1).slice(a, b - a).fill_null("").to_pylist())
                binary = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((offsets * 4).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), binary, pa.array(np.diff(offsets), pa.int64()), pa.array(decoded, pa.string())], ["id", "ids", "n_tokens", "decoded"])

    out = narrow.mapInArrow(encode, f"id {narrow.schema['id'].dataType.simpleString()}, ids binary, n_tokens long, decoded string")
    return out.withColumnRenamed("id", id_col)


ship_by_value(__name__)
