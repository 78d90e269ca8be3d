"""Token counts by a unigram model over a shared trie.

The distinct pre-tokens of a batch form a trie.  Every node gets the best
segmentation score of its prefix and that segmentation's number of tokens, once
for all pre-tokens that share it.  A pre-token's count is read at its end.

The pieces come from a public vocabulary, in order of rank; a piece's score is
its log-probability under Zipf's law for that rank.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from driftline.llm.textbatch import runs, split_words, utf8

#: Marks the start of a word in the vocabulary.
MARK = "▁"
#: A character without a piece costs this much more than the rarest piece, and a token for each of its bytes.
UNKNOWN_GAP = 10.0
#: Counts of so many distinct pre-tokens are kept between batches of a task.
KEPT = 200_000
#: The trie of pre-tokens up to this length is walked level by level, all nodes of a level at once; that of longer ones
#: depth first, as their levels are thin.  Either way a prefix is scored once.
WIDE = 256


def zipf_scores(n: int) -> np.ndarray:
    """Log-probabilities of ranks 1..n under Zipf's law."""
    weight = 1.0 / (np.arange(n) + 2.7)
    return np.log(weight / weight.sum())


def vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model file, in order of rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


@dataclass
class Unigram:
    """A vocabulary as a trie over code points with sorted edges, ready for bulk lookups."""

    edges: np.ndarray  # sorted keys: state << 21 | code point
    targets: np.ndarray  # the state each edge leads to
    score: np.ndarray  # of the piece that ends in a state, or -inf
    unknown: float
    longest: int
    pieces: dict[str, float]

    @classmethod
    def build(cls, pieces: list[str]) -> Unigram:
        scores = zipf_scores(len(pieces))
        edges: dict[int, int] = {}
        ends: dict[int, float] = {}
        for piece, score in zip(pieces, scores.tolist(), strict=True):
            state = 0
            for c in piece:
                state = edges.setdefault(state << 21 | ord(c), len(edges) + 1)
            ends[state] = max(score, ends.get(state, -np.inf))
        keys = np.array(sorted(edges), dtype=np.int64)
        targets = np.array([edges[k] for k in keys.tolist()], dtype=np.int64)
        score = np.full(len(edges) + 1, -np.inf)
        score[list(ends)] = list(ends.values())
        return cls(keys, targets, score, float(scores.min()) - UNKNOWN_GAP, max(map(len, pieces), default=1), dict(zip(reversed(pieces), scores[::-1].tolist(), strict=True)))

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states after one more character; -1 where the vocabulary has no such prefix."""
        if not len(self.edges):
            return np.full(len(state), -1)
        key = (state << 21) | code
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        return np.where((state >= 0) & (self.edges[at] == key), self.targets[at], -1)


def _deep_counts(model: Unigram, words: list[str]) -> list[int]:
    """Counts of long pre-tokens: the trie is walked depth first, so scores of a shared prefix are kept from word to word."""
    best, used, path = [0.0], [0], ""
    out = [0] * len(words)
    for i in sorted(range(len(words)), key=words.__getitem__):
        word = words[i]
        shared = _shared_prefix(path, word)
        del best[shared + 1 :], used[shared + 1 :]
        for stop in range(shared + 1, len(word) + 1):
            bare = model.pieces.get(word[stop - 1])
            score = best[-1] + (model.unknown if bare is None else bare)
            count = used[-1] + (1 if bare is not None else len(word[stop - 1].encode("utf-8", "surrogatepass")))
            for start in range(max(0, stop - model.longest), stop - 1):
                piece = model.pieces.get(word[start:stop])
                if piece is not None:
                    total, n = best[start] + piece, used[start] + 1
                    if total > score or (total == score and n < count):
                        score, count = total, n
            best.append(score)
            used.append(count)
        out[i], path = used[-1], word
    return out


def _shared_prefix(a: str, b: str) -> int:
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def token_counts(model: Unigram, words: list[str]) -> np.ndarray:
    """Tokens of each distinct pre-token's best segmentation; ties take fewer tokens."""
    long = [i for i, w in enumerate(words) if len(w) > WIDE]
    if long:
        out = np.zeros(len(words), dtype=np.int64)
        short = [i for i, w in enumerate(words) if len(w) <= WIDE]
        out[short] = token_counts(model, [words[i] for i in short])
        out[long] = _deep_counts(model, [words[i] for i in long])
        return out
    order = sorted(range(len(words)), key=words.__getitem__)
    out = np.zeros(len(words), dtype=np.int64)
    lens = np.array([len(words[i]) for i in order], dtype=np.int64)
    codes = np.frombuffer("".join(words[i] for i in order).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    begin = np.cumsum(lens) - lens
    # In sorted order, prefixes of equal words are neighbours: a word's node at a depth is the one
    # before it as long as both share that many characters.
    node = np.zeros(len(words), dtype=np.int64)  # the node of each word's prefix of the current depth
    best = [np.zeros(1)]
    used = [np.zeros(1, dtype=np.int64)]
    parents = [np.zeros(1, dtype=np.int64)]
    # Of each node, the vocabulary states of the last suffixes: column k starts k characters before.
    states = np.full((1, model.longest), -1, dtype=np.int64)
    states[:, 0] = 0
    ends = np.flatnonzero(lens == 0)
    out[np.array(order, dtype=np.int64)[ends]] = 0
    alive = np.flatnonzero(lens > 0)
    depth = 0
    while len(alive):
        char = codes[begin[alive] + depth]
        parent = node[alive]
        fresh = np.ones(len(alive), dtype=bool)
        fresh[1:] = (parent[1:] != parent[:-1]) | (char[1:] != char[:-1])
        child = np.cumsum(fresh) - 1
        up, code = parent[fresh], char[fresh]
        depth += 1
        reach = min(model.longest, depth)
        moved = np.full((len(up), model.longest), -1, dtype=np.int64)
        score = np.full(len(up), -np.inf)
        count = np.zeros(len(up), dtype=np.int64)
        above = up  # the node k characters before, for growing k
        for k in range(1, reach + 1):
            state = model.step(states[up, k - 1], code)
            if k < model.longest:
                moved[:, k] = state
            piece = np.where(state >= 0, model.score[state], -np.inf)
            tokens = np.ones(len(up), dtype=np.int64)
            if k == 1:
                bare = np.isneginf(piece)
                piece = np.where(bare, model.unknown, piece)
                size = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
                tokens = np.where(bare, size, 1)
            total, n = best[depth - k][above] + piece, used[depth - k][above] + tokens
            better = (total > score) | ((total == score) & (n < count))
            score, count = np.where(better, total, score), np.where(better, n, count)
            if k < reach:
                above = parents[depth - k][above]
        moved[:, 0] = 0
        best.append(score)
        used.append(count)
        parents.append(up)
        if depth > model.longest:  # no piece reaches further back
            best[depth - model.longest - 1] = used[depth - model.longest - 1] = parents[depth - model.longest] = np.zeros(0)
        states = moved
        node[alive] = child
        done = lens[alive] == depth
        out[np.array(order, dtype=np.int64)[alive[done]]] = count[child[done]]
        alive = alive[~done]
    return out


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_words, n_tokens)`` of every whole text.

    Words are separated by ASCII white space; each is a pre-token with the mark
    of a word's start in front.  Null and blank texts have no words and no
    tokens; rows that repeat are counted each; other columns are ignored.
    ``path`` names a sentencepiece model file; the driver reads it and sends the pieces.
    """
    pieces = vocabulary(path)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram.build(pieces)
        kept: dict[bytes, int] = {}
        for batch in batches:
            buf, offsets = utf8(batch.column("text"))
            n_words, n_tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lo, hi in runs(offsets):
                words = split_words(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                tokens = words.buf.tobytes().split(b" ")[:-1]
                new = list({t for t in tokens if t not in kept})
                if len(kept) + len(new) > KEPT:
                    kept.clear()
                    new = list(set(tokens))
                for t, n in zip(new, token_counts(model, [MARK + t.decode("utf-8", "replace") for t in new]).tolist(), strict=True):
                    kept[t] = n
                counts = np.fromiter(map(kept.__getitem__, tokens), np.int64, len(tokens))
                sums = np.concatenate([[0], np.cumsum(counts)])
                n_words.append(words.counts)
                n_tokens.append(np.diff(sums[words.first]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(n_words), pa.int64()), pa.array(np.concatenate(n_tokens), pa.int64())],
                ["doc_id", "n_words", "n_tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, n_words long, n_tokens long")
