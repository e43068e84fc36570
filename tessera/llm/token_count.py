"""Token counts of whole texts under a sentencepiece BPE model, by rank-synchronous array merging.

Texts are cut into pre-tokens that no piece crosses (a run of word marks and what follows up to the next one; line
ends stand alone), and these again between two characters that are neighbours in no piece, so texts in unspaced scripts
fall into short sequences too. Distinct pre-tokens of a batch are merged together: their symbols lie in one flat array,
and each round applies, in every sequence at once, its leftmost pair of lowest rank. What is left is counted; symbols
that the vocabulary lacks count one token for each of their UTF-8 bytes. A sequence that is still longer than ``LONG``
(a letter repeated hundreds of times, say) would need as many rounds: it is merged by itself with a heap of pairs, which
gives the same count in time near to linear.

Nulls and empty texts have 0 bytes and 0 tokens. Very long texts are counted whole, each in one worker. Rows are neither
merged nor dropped, and repeated ones are counted alike; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessera.llm import common

LIMIT = 4096
MARK = "▁"
#: Counts of pre-tokens that a Python worker keeps.
CACHE_WORDS = 1_000_000
#: Sequences of more symbols are merged one by one with a heap, for rounds would be many.
LONG = 256
NONE = np.int32(2**31 - 1)

_models: dict[str, Merges] = {}


class Merges:
    """The merges of a model's normal pieces: for each pair of adjacent pieces that make a piece, its rank and id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        ids = {model.id_to_piece(i): i for i in normal}
        rank_of = {i: r for r, i in enumerate(sorted(normal, key=lambda i: (-model.get_score(i), i)))}
        self.size = model.vocab_size()
        self.symbol = np.full(0x110000, -1, np.int32)
        pairs, neighbours = [], set()
        for piece, i in ids.items():
            neighbours.update(zip(piece, piece[1:], strict=False))
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
            for k in range(1, len(piece)):
                if (a := ids.get(piece[:k])) is not None and (b := ids.get(piece[k:])) is not None:
                    pairs.append((a * self.size + b, rank_of[i], i))
        pairs.sort()
        self.key, self.rank, self.made = (np.array(x) for x in zip(*pairs, strict=True))
        self.rank = self.rank.astype(np.int32)
        self.table = {int(k): (int(r), int(m)) for k, r, m in pairs}
        #: characters that are neighbours in some piece, as one number each
        self.neighbours = np.sort(np.array([ord(a) << 21 | ord(b) for a, b in neighbours] or [-1], np.int64))
        #: merged id by rank: a rank names one piece
        self.by_rank = np.zeros(int(self.rank.max()) + 1, np.int32)
        self.by_rank[self.rank] = self.made

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs; NONE where they make no piece."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (left >= 0) & (right >= 0), self.rank[at], NONE)

    def count(self, tokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token; those are not empty."""
        length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        points = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32)
        own = np.repeat(np.arange(len(tokens)), length)
        cut = np.ones(len(points), bool)
        key = points[:-1].astype(np.int64) << 21 | points[1:]
        at = np.minimum(np.searchsorted(self.neighbours, key), len(self.neighbours) - 1)
        cut[1:] = (own[1:] != own[:-1]) | (self.neighbours[at] != key)
        first = np.flatnonzero(cut)
        size = np.diff(np.append(first, len(points)))
        sym, seq = self.symbol[points], np.cumsum(cut) - 1
        # a symbol that is not in the vocabulary is as many tokens as it has bytes
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        total = np.bincount(seq, np.where(sym < 0, width - 1, 0), len(first)).astype(np.int64)
        for k in np.flatnonzero(size > LONG):
            total[k] += self._one(sym[first[k] : first[k] + size[k]].tolist())
        short = (size <= LONG)[seq]
        self._merge(sym[short], seq[short], total)
        return np.bincount(own[first], total, len(tokens)).astype(np.int64)

    def _merge(self, sym: np.ndarray, seq: np.ndarray, total: np.ndarray) -> None:
        """Merge all sequences together and add what is left of each to total."""
        rank = np.full(len(sym), NONE, np.int32)
        rank[:-1] = np.where(seq[1:] == seq[:-1], self.ranks(sym[:-1], sym[1:]), NONE)
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            low = np.minimum.reduceat(rank, first)
            ends = np.append(first[1:], len(sym))
            done = low == NONE
            total[seq[first[done]]] += (ends - first)[done]
            if done.all():
                break
            at = np.flatnonzero(rank == np.repeat(low, ends - first))
            at = at[rank[at] != NONE]
            at = at[np.concatenate([[True], seq[at[1:]] != seq[at[:-1]]])]  # the leftmost of each sequence
            sym[at] = self.by_rank[rank[at]]
            keep = np.repeat(~done, ends - first)
            keep[at + 1] = False
            moved = np.zeros(len(sym), bool)
            moved[at] = True
            sym, seq, rank, moved = sym[keep], seq[keep], rank[keep], moved[keep]
            at = np.flatnonzero(moved)
            for left in (at, at[at > 0] - 1):
                right = np.minimum(left + 1, len(sym) - 1)
                rank[left] = np.where((seq[right] == seq[left]) & (right > left), self.ranks(sym[left], sym[right]), NONE)

    def _one(self, sym: list[int]) -> int:
        """What is left of one long sequence, with a heap of pairs and linked symbols."""
        n = len(sym)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and sym[i] >= 0 and sym[j] >= 0 and (found := self.table.get(sym[i] * self.size + sym[j])):
                heapq.heappush(heap, (found[0], i, sym[i], sym[j], found[1]))

        for i in range(n - 1):
            offer(i)
        left = n
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            if not alive[i] or sym[i] != a or (j := after[i]) >= n or sym[j] != b:
                continue
            sym[i], alive[j], after[i] = made, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            left -= 1
            offer(i)
            offer(before[i])
        return left


class Counter:
    """Counts of whole texts, keeping those of the pre-tokens seen before."""

    def __init__(self, path: str):
        if path not in _models:
            _models[path] = Merges(path)
        self.merges, self.known = _models[path], {}

    def counts(self, text: pa.Array) -> np.ndarray:
        odd = pc.or_(pc.match_substring(text, "  "), pc.or_(pc.starts_with(text, " "), pc.match_substring(text, MARK))).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", text)
        plain = pc.replace_substring(pc.replace_substring(plain, " ", f" {MARK}"), "\n", " \n ")
        plain = pc.if_else(pc.equal(plain, ""), "", pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), plain, pa.scalar("", pa.large_string())))
        pieces = pc.split_pattern(plain, " ")
        coded = pc.list_flatten(pieces).dictionary_encode()
        sizes = pc.list_value_length(pieces).to_numpy(zero_copy_only=False)
        each = self._counts(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy(zero_copy_only=False)]
        ends = np.cumsum(sizes)
        sums = np.concatenate([[0], np.cumsum(each)])
        out = sums[ends] - sums[ends - sizes]
        for i in np.flatnonzero(odd):  # runs of spaces, or word marks in the text
            marked = MARK + text[int(i)].as_py().replace(" ", MARK)
            out[i] = self._counts(re.findall(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+", marked)).sum()
        return out

    def _counts(self, tokens: list[str]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        known[""] = 0
        if fresh := [t for t in dict.fromkeys(tokens) if t not in known]:
            known.update(zip(fresh, self.merges.count(fresh).tolist(), strict=True))
        return np.fromiter((known[t] for t in tokens), np.int64, len(tokens))


def count_tokens(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """Per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model)
        for batch in common.slices(batches):
            text = batch.column("text")
            n = counter.counts(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.binary_length(text), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
