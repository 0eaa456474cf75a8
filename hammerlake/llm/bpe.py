"""Encoding and decoding with a tokenizer of whole words (lower case, word ends)."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._util import pick, slices
from .merging import PairIndex, Words

#: Text of which one task holds the distinct words at a time.
CHUNK_BYTES = 16 << 20


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it is printable, else one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


class WordTokenizer:
    """What ``word_bpe`` files of the tokenizers library define, read from their JSON.

    The normaliser (NFC, white space as a space, lower case), the pattern of the pre-tokenizer, the merges and the
    added tokens come from the file; other kinds of files are refused.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or steps != ["NFC", "Replace", "Lowercase"] or spec["decoder"]:
            raise ValueError(f"{path} is not a word tokenizer of the kind that is read here")
        vocab: dict[str, int] = model["vocab"]
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.added, self.pattern = added, spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.tokens = [""] * (max(*vocab.values(), *added.values()) + 1)
        for token, i in (*vocab.items(), *added.items()):
            self.tokens[i] = token
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int32)
        self.last = np.array([vocab[x + "</w>"] for x in letters], np.int32)
        left, right = (np.array([vocab[m[k]] for m in model["merges"]], np.int32) for k in (0, 1))
        result = np.array([vocab[a + b] for a, b in model["merges"]], np.int32)
        self.index = PairIndex(left, right, np.arange(len(left)), result, len(self.tokens))

    def splitter(self) -> "Splitter":
        return Splitter(self.pattern, list(self.added))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, joined, and how many each has; an added token is a word of one id."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(size)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[flat]
        if len(raw):
            symbols[ends - 1] = self.last[flat[ends - 1]]
        ids, counts = self.index.encode(symbols, ends - size)
        special = [(k, self.added[w]) for k, w in enumerate(words) if w in self.added]
        for k, token in reversed(special):
            at = int(counts[:k].sum())
            ids = np.concatenate([ids[:at], [token], ids[at + counts[k] :]])
            counts[k] = 1
        return ids.astype(np.int32), counts

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces: the file has no decoder, and special tokens are kept."""
        return " ".join([self.tokens[i] for i in ids])


class Splitter:
    """Cuts texts at white space, and each distinct part of a text into the words that the merges see."""

    def __init__(self, pattern: str, added: list[str]) -> None:
        self.words = regex.compile(pattern).findall
        self.special = set(added)
        self.added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")")
        self.spaces = regex.compile(r"\s+").split
        self.separators = regex.compile("[\x1c-\x1f]").search  # white space to str.split, but not to the tokenizer

    def parts(self, text: str) -> list[str]:
        """What stands between white space, normalised; an added token is a part by itself."""
        if "<|" not in text:
            return self.plain(text)
        return [w for k, part in enumerate(self.added.split(text)) for w in ([part] if k % 2 else self.plain(part))]

    def plain(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        # the library lower-cases each character by itself, so a final sigma is like any other
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return list(filter(None, self.spaces(text))) if self.separators(text) else text.split()

    def cut(self, part: str) -> list[str]:
        return [part] if part in self.special else self.words(part)

    def __call__(self, text: str) -> list[str]:
        return [w for part in self.parts(text) for w in self.cut(part)]


def _gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The values of the chosen runs, joined."""
    n = counts[chosen]
    ends = np.cumsum(n)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[chosen] - (ends - n), n)]


def _code(batches: Iterator[pa.RecordBatch], tokenizer: WordTokenizer, texts_too: bool) -> Iterator[pa.RecordBatch]:
    split = tokenizer.splitter()
    names = ["doc_id", "ids", "decoded"] if texts_too else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    for batch in batches:
        for part in slices(batch, "text", CHUNK_BYTES):
            parts, words = Words(), Words()
            docs = [parts.numbers(split.parts(t.as_py() or "")) for t in part.column("text")]
            cut = [split.cut(w) for w in parts]  # once for each distinct part
            flat = words.numbers([*chain.from_iterable(cut)])
            ids, counts = tokenizer.encode_words(list(words))
            starts = np.cumsum(counts) - counts
            size = np.fromiter(map(len, cut), np.int64, len(cut))
            ids = _gather(ids, starts, counts, flat)
            lengths = np.concatenate([[0], np.cumsum(counts[flat])])
            ends = np.cumsum(size)
            counts = lengths[ends] - lengths[ends - size]  # from here on of parts
            starts, tokens = lengths[ends - size], ids.tolist()
            decoded = [tokenizer.decode(tokens[a : a + n]) for a, n in zip(starts.tolist(), counts.tolist())].__getitem__
            columns: list[list] = [[], []] if texts_too else [[], [], []]
            for numbers in docs:
                of = _gather(ids, starts, counts, numbers)
                text = " ".join(map(decoded, numbers.tolist()))
                new = (of, text) if texts_too else (len(of), hashlib.sha256(of.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                for c, v in zip(columns, new):
                    c.append(v)
            kinds = (pa.list_(pa.int32()), pa.string()) if texts_too else (pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", texts_too: bool = False) -> DataFrame:
    """Ids of each whole text, and the text that they decode to.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row (SHA-256 of the ids as little-endian
    unsigned 32-bit integers, and of the decoded text in UTF-8), or with ``texts_too`` ``doc_id, ids, decoded``.
    Each task gathers the distinct words of ``CHUNK_BYTES`` of text (or of one longer text), merges them in one
    pair occurrence index, and puts the documents together from them; nothing is shuffled.

    Null texts are empty; texts without words have no ids and decode to nothing. Repeated rows are each returned,
    null doc_ids too. An empty table gives no rows.
    """
    tokenizer = WordTokenizer(path)
    layout = "doc_id long, ids array<int>, decoded string" if texts_too else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return pick(docs, id_col, text_col).mapInArrow(lambda batches: _code(batches, tokenizer, texts_too), layout)
