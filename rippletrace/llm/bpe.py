"""Byte-level BPE by speculation and verification.

A word's tokens are guessed by greedy longest match. A sequence of tokens is
what the merges yield if and only if each two neighbours, merged on their own,
stay as they are. Those checks are made for all guesses of a batch at once, with
a table of pairs seen so far; only words with a failing pair are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from rippletrace.llm.common import add_columns

#: Fixed value: how byte-level BPE cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _recent() -> tuple[re.Pattern, re.Pattern]:
    """Patterns of letters and digits that Python's own character data doesn't know yet.

    Libraries differ in the Unicode version they follow, so words around such
    characters may be cut differently. The first pattern is a fast superset.
    """
    every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
    new = sorted(c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn")
    if not new:
        return re.compile(r"(?!)"), re.compile(r"(?!)")
    runs: list[list[int]] = []
    for c in map(ord, new):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return re.compile(f"[{new[0]}-\U0010ffff]"), re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs) + "]")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files of this kind, as letter -> byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def check_settings(spec: dict) -> None:
    """Raise ValueError if a tokenizer file asks for what isn't done here, rather than encode differently."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    wanted = {"pre_tokenizer.type": (pre.get("type"), "ByteLevel"), "add_prefix_space": (pre.get("add_prefix_space", True), False), "use_regex": (pre.get("use_regex", True), True)}
    wanted |= {"normalizer": (spec.get("normalizer"), None), "model.type": (model.get("type", "BPE"), "BPE"), "decoder.type": ((spec.get("decoder") or {}).get("type"), "ByteLevel")}
    wanted |= {k: (model.get(k) or None, None) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")}
    flags = [f for t in spec.get("added_tokens", ()) for f in ("single_word", "lstrip", "rstrip", "normalized") if t.get(f)]
    wrong = [f"{k} = {v!r}" for k, (v, right) in wanted.items() if v != right] + sorted({f"added_tokens.{f}" for f in flags})
    if wrong:
        raise ValueError("not supported: " + ", ".join(wrong))


class SpeculativeBpe:
    """Encoder and decoder for one vocabulary.

    ``spec`` is the text of a tokenizer file with a byte-level BPE model. Words
    seen before are looked up; the table of words and that of pairs are emptied
    when they have ``most_words`` entries, and texts of ``most_letters``
    together, or a single longer one, are cut into words at once, so memory is
    bounded.
    """

    def __init__(self, spec: str, most_words: int = 200_000, most_letters: int = 2_000_000) -> None:
        self.library = Tokenizer.from_str(spec).pre_tokenizer
        spec = json.loads(spec)
        check_settings(spec)
        letters = _byte_letters()
        to_bytes = lambda token: bytes(letters[c] for c in token)
        self.ids = {to_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        self.bytes_of = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.longest = max(map(len, self.ids))
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = (to_bytes(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            self.ranks[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.bytes_ids = [self.ids[bytes([b])] for b in range(256)]
        self.cut_words = regex.compile(WORDS).findall
        self.recent = _recent()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.most_words, self.most_letters = most_words, most_letters
        self.words: dict[str, bytes] = {}
        self.sound = np.zeros(0, "int64")  # pairs known to stay, sorted
        self.unsound = np.zeros(0, "int64")  # pairs known to change, sorted
        self.speculated = self.merged = 0
        # Whether a token, merged from its bytes, comes out as itself.
        self.whole: dict[int, bool] = {}

    def split(self, text: str) -> list[str]:
        """Words of a text; where Unicode versions matter, as the library cuts them."""
        if not text.isascii() and self.recent[0].search(text) and self.recent[1].search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.cut_words(text)

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the lowest-ranked pair first, the leftmost of equals."""
        ids = [self.bytes_ids[b] for b in word]
        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(*r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.ranks.get((ids[i], ids[i + 1])))]
        heap = [(rank, i, new, a, b) for rank, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (r := self.ranks.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (r[0], x, r[1], ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        found = self.ids.get(word)
        if found is not None:
            return [found]
        out, at, n, ids = [], 0, len(word), self.ids
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                found = ids.get(word[at:end])
                if found is not None:
                    break
            out.append(found)
            at = end
        return out

    def _known(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each pair (left * 2**32 + right) stays as it is."""
        for stays, table in ((True, self.sound), (False, self.unsound)):
            at = np.minimum(np.searchsorted(table, pairs), max(len(table) - 1, 0))
            hit = table[at] == pairs if len(table) else np.zeros(len(pairs), bool)
            pairs_left = pairs[~hit]
            if stays:
                good, rest = hit, pairs_left
            else:
                rest = np.intersect1d(rest, pairs_left)
        if len(new := np.unique(rest)):
            if len(self.sound) + len(self.unsound) > 4 * self.most_words:
                self.sound = self.unsound = np.zeros(0, "int64")
            verdict = np.array([self.merge(self.table[p >> 32] + self.table[p & 0xFFFFFFFF]) == [p >> 32, p & 0xFFFFFFFF] for p in new.tolist()], bool)
            self.sound = np.union1d(self.sound, new[verdict])
            self.unsound = np.union1d(self.unsound, new[~verdict])
            at = np.minimum(np.searchsorted(new, pairs), len(new) - 1)
            good = good | ((new[at] == pairs) & verdict[at])
        return good

    def learn(self, words: list[str]) -> None:
        """Put the encodings of ``words``, all different, into the table."""
        raw = [w.encode() for w in words]
        guesses = [self.propose(w) for w in raw]
        n = np.fromiter(map(len, guesses), "int64", len(guesses))
        flat = np.fromiter((i for g in guesses for i in g), "int64", int(n.sum()))
        ends = np.cumsum(n)
        good = np.ones(len(words), bool)
        # Neighbours within a word: all but the pairs that span two words.
        inside = np.ones(max(len(flat) - 1, 0), bool)
        inside[ends[:-1] - 1] = False
        if inside.any():
            owner = np.repeat(np.arange(len(words)), n)[:-1][inside]
            fine = self._known((flat[:-1][inside] << 32) | flat[1:][inside])
            good[owner[~fine]] = False
        for i in np.flatnonzero(n == 1).tolist():
            token = guesses[i][0]
            if token not in self.whole:
                self.whole[token] = self.merge(raw[i]) == [token]
            good[i] = self.whole[token]
        self.speculated += int(good.sum())
        self.merged += int((~good).sum())
        for word, data, guess, ok in zip(words, raw, guesses, good.tolist()):
            self.words[word] = np.array(guess if ok else self.merge(data), "<u4").tobytes()

    def encode_batch(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        out, first, letters = [], 0, 0
        for i, text in enumerate(texts):
            letters += len(text or "")
            if letters > self.most_letters and i > first:
                out += self._encode(texts[first:i])
                first, letters = i, len(text or "")
        return out + self._encode(texts[first:])

    def _encode(self, texts: Sequence[str | None]) -> list[bytes]:
        parts = []
        for text in texts:
            pieces = self.cut(text or "") if self.cut else [text or ""]
            parts.append([[piece] if i % 2 else self.split(piece) for i, piece in enumerate(pieces)])
        if len(self.words) > self.most_words:
            self.words.clear()
        if not self.words:
            self.words |= {s: np.array([i], "<u4").tobytes() for s, i in self.special.items()}
        new = {w for text in parts for words in text for w in words if w not in self.words}
        if new:
            self.learn(list(new))
        get = self.words.__getitem__
        return [b"".join(b"".join(map(get, words)) for words in text) for text in parts]

    def decode(self, ids: bytes) -> str:
        table = self.table
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", errors="replace")


_made: dict[str, SpeculativeBpe] = {}


def _coder(spec: str) -> SpeculativeBpe:
    """One coder per Python worker and vocabulary."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = SpeculativeBpe(spec)
    return _made[key]


def encode_texts(
    docs: DataFrame, vocabulary: str, text: str = "text", into: str = "token_ids", decoded: str | None = None, keep: Sequence[str] | None = None
) -> DataFrame:
    """Add the token ids of every whole text, as binary of little-endian unsigned 32-bit integers.

    ``vocabulary`` is the path of a tokenizer file with a byte-level BPE model.
    The driver reads it; its content, of a fixed size, goes to the executors as
    a broadcast variable. Strings of special tokens in a text become those
    tokens. With ``decoded``, a column of that name holds the text decoded from
    the ids. With ``keep``, only those columns of the input are returned.

    A null or empty text has no ids and decodes to the empty text. Other columns
    pass unchanged, whatever they hold; columns named as a new one are replaced.
    Repeated rows and an empty table need no special care. One pass without a
    shuffle; a task holds one Arrow batch and the bounded tables of the coder.
    """
    with open(vocabulary, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())
    new = [(into, T.BinaryType(), pa.binary())]
    if decoded:
        new.append((decoded, T.StringType(), pa.string()))

    def start():
        coder = _coder(spec.value)

        def make(texts: list) -> list[list]:
            ids = coder.encode_batch(texts)
            return [ids, [coder.decode(i) for i in ids]] if decoded else [ids]

        return make

    return add_columns(docs, text, start, new, keep)


def encode_digests(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, n_tokens, and the sha256 of the ids and of the text decoded from them."""
    coded = encode_texts(docs.select(key, text), vocabulary, text, "token_ids", "decoded_text", keep=[key])
    return coded.select(
        key,
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded_text").cast("binary"), 256).alias("decoded_sha256"),
    )
