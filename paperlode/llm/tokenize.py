"""Problem 6: token ids of every text by a public byte-level BPE vocabulary.

Each text is cut by the vocabulary's pre-token pattern. The UTF-8 bytes of a piece are read as Latin-1, so that
the Aho-Corasick automaton over the vocabulary finds all tokens at all places in one pass. From the left, the
longest token is taken whose pairing with the token before it is one that byte-pair merging would leave alone;
if none fits, the last choice is undone and the next shorter one tried. A place from which no valid rest can
follow is remembered, so a piece takes linear time. The answer for a pair of adjacent tokens is memoised.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode.session import spread

TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces and pairs of tokens whose answers a worker keeps at most.
PIECES_KEPT, PAIRS_KEPT = 50_000, 250_000


class ByteBpe:
    """Encoder of one vocabulary. Ids are merge ranks; ids below 256 are single bytes."""

    def __init__(self, directory: str = TOKENIZER_DIR, name: str = "byte_bpe_50k"):
        import ahocorasick
        import regex

        with open(f"{directory}/{name}.tiktoken", "rb") as lines:
            ranks = {base64.b64decode(t): int(i) for t, i in (line.split() for line in lines if line.strip())}
        self.ids = {t.decode("latin-1"): i for t, i in ranks.items()}
        self.find = regex.compile(PATTERN).findall
        self.automaton = ahocorasick.Automaton()
        for text, i in self.ids.items():
            self.automaton.add_word(text, (len(text), i))
        self.automaton.make_automaton()
        self.halves = self._halves(ranks)
        self.joined = {pair: i for i, pair in self.halves.items()}
        self.pair_ok: dict[int, bool] = {}
        self.pieces: dict[str, list[int]] = {}

    @staticmethod
    def _halves(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
        """The two tokens whose merge makes each token: the pair left when only lower merges are applied."""
        halves = {}
        for token, rank in ranks.items():
            if len(token) < 2:
                continue
            parts = [bytes([b]) for b in token]
            while len(parts) > 2:
                options = [(ranks.get(a + b, rank), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))]
                best, k = min(options)
                if best >= rank:
                    break
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) == 2:
                halves[rank] = (ranks[parts[0]], ranks[parts[1]])
        return halves

    def keeps_apart(self, left: int, right: int) -> bool:
        """Whether merging, run on the joined bytes of two tokens, ends in just these two tokens.

        Both tokens are taken apart from the last merge to the first. At each step the two parts that face each
        other across the border must not have a merge that comes before the merges already undone.
        """
        pair = left << 32 | right  # a number takes a third of a tuple's memory
        known = self.pair_ok.get(pair)
        if known is not None:
            return known
        a, b, before, ok = left, right, 1 << 30, True
        while True:
            across = self.joined.get((a, b))
            if across is not None and across < before:
                ok = False
                break
            undo_a, undo_b = self.halves.get(a), self.halves.get(b)
            if undo_a is None and undo_b is None:
                break
            # of two equal merges the left one came first, so the right one is undone first
            if undo_b is None or (undo_a is not None and a > b):
                before, a = a, undo_a[1]
            else:
                before, b = b + 1, undo_b[0]
        if len(self.pair_ok) >= PAIRS_KEPT:
            self.pair_ok.clear()
        self.pair_ok[pair] = ok
        return ok

    def _piece(self, piece: str) -> list[int]:
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        end = len(piece)
        at: list[list[tuple[int, int]]] = [[] for _ in range(end)]
        for last, hit in self.automaton.iter(piece):
            at[last - hit[0] + 1].append(hit)  # ends rise, so each list runs from short to long
        ids: list[int] = []
        choice = [len(at[0]) - 1]
        place, dead, keeps = [0], set(), self.keeps_apart
        while place[-1] < end:
            here, k = place[-1], choice[-1]
            hits, before = at[here], ids[-1] if ids else None
            while k >= 0:
                size, token = hits[k]
                if (here + size, token) not in dead and (before is None or keeps(before, token)):
                    break
                k -= 1
            if k < 0:  # nothing fits behind the token before: it is a dead end here
                place.pop()
                choice.pop()
                dead.add((here, ids.pop()))
                choice[-1] -= 1
                continue
            choice[-1] = k
            ids.append(token)
            place.append(here + size)
            choice.append(len(at[here + size]) - 1 if here + size < end else -1)
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty texts give an empty list. Lone surrogates count as U+FFFD."""
        if not text:
            return []
        out: list[int] = []
        kept = self.pieces
        for piece in self.find(text):
            ids = kept.get(piece)
            if ids is None:
                ids = self._piece(piece.encode("utf-8", "replace").decode("latin-1"))
                if len(piece) <= 16 and len(kept) < PIECES_KEPT:
                    kept[piece] = ids
            out += ids
        return out


@lru_cache(maxsize=4)
def encoder(directory: str, name: str) -> ByteBpe:
    """One encoder for each Python worker."""
    return ByteBpe(directory, name)


def tokenize(df: DataFrame, key: str = "doc_id", text: str = "text", directory: str = TOKENIZER_DIR, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, ids) for every row of df, in one narrow stage without a shuffle.

    Null, empty: an empty list. Blank texts are encoded as they are. Repeated rows stay repeated. Very long texts
    are encoded whole. Other columns, also one called ids, are not read. An empty table gives an empty table.
    """

    @F.pandas_udf("array<int>")
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = encoder(directory, name)
        for part in parts:
            yield part.map(bpe.encode, na_action=None)

    return spread(df.select(key, text)).select(key, ids(text).alias("ids"))
