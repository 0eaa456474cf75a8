"""Token counts of sentencepiece models from counts of distinct pre-tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._util import pick, slices
from .merging import PairIndex, Words

CHUNK_BYTES = 16 << 20
LIMIT = 4096
SPACE = "▁"


class PieceCounter:
    """Counts the pieces of pre-tokens under a BPE model with byte fallback.

    A pre-token is a run of space marks with what follows up to the next space mark, or one control character that
    no piece holds. No piece has a space mark after another character, so no merge crosses the ends of pre-tokens
    and their counts add up; models with such pieces are refused.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        score = {model.id_to_piece(i): model.get_score(i) for i in ids}
        if any(SPACE in p.lstrip(SPACE) for p in score) or not any(model.is_byte(i) for i in range(model.get_piece_size())):
            raise ValueError(f"{path}: pieces cross words, or there is no byte fallback")
        symbols = {p: k for k, p in enumerate(dict.fromkeys([*score, *(c for p in score for c in p)]))}
        self.unknown = len(symbols)
        order = sorted((p for p in score if len(p) > 1), key=lambda p: -score[p])
        rank = dict(zip(order, np.cumsum([0] + [score[p] != score[q] for q, p in zip(order, order[1:])]).tolist()))
        rows = [(symbols[p[:k]], symbols[p[k:]], rank[p], symbols[p]) for p in order for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        self.index = PairIndex(*(np.array(c, np.int64) for c in zip(*rows)), self.unknown + 1)
        self.by_point = np.full(0x110000, self.unknown, np.int32)
        self.own = np.zeros(self.unknown + 1, np.int64)  # tokens of each symbol: characters outside the vocabulary are bytes
        for p, k in symbols.items():
            if len(p) == 1:
                self.by_point[ord(p)] = k
            self.own[k] = 1 if p in score else len(p.encode())
        apart = "".join(re.escape(chr(c)) for c in range(32) if not any(chr(c) in p for p in score))
        self.pattern = f"[{apart}]|{SPACE}+[^{SPACE}{apart}]*|[^{SPACE}{apart}]+"

    def counts(self, words: list[str]) -> np.ndarray:
        """The number of tokens of each of some distinct pre-tokens."""
        if not words:
            return np.zeros(0, np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.cumsum(size) - size
        symbols = self.by_point[points]
        pieces, n = self.index.encode(symbols, starts)
        first = np.cumsum(n) - n
        total = np.add.reduceat(self.own[pieces], first)
        missing = np.where(symbols == self.unknown, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), 0)
        return total + np.add.reduceat(missing, starts)


def _count(batches: Iterator[pa.RecordBatch], counter: PieceCounter, limit: int) -> Iterator[pa.RecordBatch]:
    find, runs = re.compile(counter.pattern).findall, re.compile(f"{SPACE}+[^{SPACE}]*").findall
    for batch in batches:
        for part in slices(batch, "text", CHUNK_BYTES):
            units, docs, sizes = Words(), [], []
            for value in part.column("text"):
                text = value.as_py() or ""
                sizes.append(len(text.encode()))
                # single spaces cut a text into units; where spaces come in runs, each keeps its own
                plain = SPACE not in text and "  " not in text and text[:1] != " " and text[-1:] != " "
                cut = text.split(" ") if plain else runs(SPACE + text.replace(" ", SPACE))
                docs.append(units.numbers(cut) if text else np.zeros(0, np.int32))
            words = Words()
            pre_tokens = [find(u if u[0] == SPACE else SPACE + u) for u in units]
            flat = words.numbers([*chain.from_iterable(pre_tokens)])
            size = np.fromiter(map(len, pre_tokens), np.int64, len(pre_tokens))
            total = np.concatenate([[0], np.cumsum(counter.counts(list(words))[flat])])
            ends = np.cumsum(size)
            of = total[ends] - total[ends - size]
            n = [int(of[d].sum()) for d in docs]
            yield pa.record_batch([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row: tokens of whole texts, without materialising ids.

    Each task counts the pieces of each distinct pre-token of ``CHUNK_BYTES`` of text (or of one longer text)
    once, joins the counts to the documents' pre-tokens by number, and adds them up. The distinct pre-tokens stay
    within the task: a join over all documents would shuffle a row for each document and pre-token, as many bytes
    as the text has.

    Null texts are empty: no bytes, no tokens. Repeated rows are each returned, null doc_ids too. An empty table
    gives no rows.
    """
    counter = PieceCounter(path)
    return pick(docs, id_col, text_col).mapInArrow(lambda batches: _count(batches, counter, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
