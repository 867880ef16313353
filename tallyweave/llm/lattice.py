"""Marginal probability of words over all segmentations into given subword pieces.

The vocabulary is read from a tokenizer's file and is never trained. Its scores weight the pieces at first;
expectation steps over a corpus's words then say how often each piece is used.

A word is ``BEGIN`` and its characters. One piece begins it, others follow, and it stops; pieces that
begin words are normalised among themselves, pieces within words with the stop. Every
character can also be spelt by its bytes, so every word has a segmentation, and the probabilities of all words add up to
at most 1.

Recursions run in log space over batches of words of like length: from the left for probabilities, from
both sides for expected uses.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BEGIN = "▁"
#: Bits of a code point in a key of the trie.
SHIFT = 21
#: Cells (words times characters) of a batch, unless one word has more.
CELLS = 100_000


@dataclass
class Pieces:
    """``texts`` of the pieces in the file's order, and the numbers of the 256 byte pieces.

    The trie's edges are sorted ``keys`` (parent and code point) with their ``child`` and the ``piece`` that
    ends there, or -1. Node 0 is the root.
    """

    texts: list[str]
    bytes: np.ndarray
    scores: np.ndarray
    keys: np.ndarray
    child: np.ndarray
    piece: np.ndarray
    longest: int


def make_pieces(texts: list[str], scores: list[float]) -> Pieces:
    """From pieces and their scores; byte pieces of score 0 are put behind the others."""
    nodes, edges, ends = {"": 0}, {}, {}
    for number, text in enumerate(texts):
        for at in range(len(text)):
            node = nodes[text[:at]]
            nxt = nodes.setdefault(text[: at + 1], len(nodes))
            edges[node << SHIFT | ord(text[at])] = nxt
        ends[nodes[text]] = number
    keys = np.array(sorted(edges), dtype=np.int64)
    child = np.array([edges[k] for k in keys.tolist()], dtype=np.int64)
    piece = np.array([ends.get(c, -1) for c in child.tolist()], dtype=np.int64)
    n = len(texts)
    return Pieces(
        texts, np.arange(n, n + 256), np.array(list(scores) + [0.0] * 256), keys, child, piece, max(map(len, texts), default=1)
    )


def read_pieces(path: str) -> Pieces:
    """The pieces of a sentencepiece model, without its special and byte pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    plain = [
        i
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    texts = [model.id_to_piece(i) for i in plain]
    scores = [model.get_score(i) for i in plain]
    # A piece that crosses a word's beginning cannot be in a word.
    kept = [n for n, t in enumerate(texts) if BEGIN not in t[1:]]
    return make_pieces([texts[n] for n in kept], [scores[n] for n in kept])


def prior(pieces: Pieces) -> np.ndarray:
    """First weights: the scores' order by Zipf's law, bytes at its end.

    Scores of merges are ranks and not logarithms, so only their order is used.
    """
    n = len(pieces.texts)
    order = np.argsort(-pieces.scores[:n], kind="stable")
    weight = np.empty(n + 256)
    weight[order] = 1.0 / (np.arange(n) + 2)
    weight[n:] = 1.0 / (n + 2)
    return weight


@dataclass
class Weights:
    """Natural logarithms: of every piece, and of a word's stop."""

    piece: np.ndarray
    stop: float


def begins(pieces: Pieces) -> np.ndarray:
    """Which pieces begin words. Bytes can spell ``BEGIN`` itself, and count as within words."""
    return np.array([t.startswith(BEGIN) for t in pieces.texts] + [False] * 256)


def normalise(pieces: Pieces, uses: np.ndarray, words: float, strength: float = 1000.0) -> Weights:
    """From expected uses and the number of words; ``strength`` uses are added by the prior."""
    first, share = begins(pieces), prior(pieces)
    total = np.empty(len(uses))
    for part in (first, ~first):
        total[part] = uses[part] + strength * share[part] / max(share[part].sum(), 1e-300)
    stop = words + 1.0
    # Spelling ``BEGIN`` by bytes takes a small part of the first step.
    weight = np.where(first, total / (total[first].sum() + 1.0), total / (total[~first].sum() + stop))
    return Weights(np.log(weight), float(np.log(stop / (total[~first].sum() + stop))))


class Lattice:
    """All arcs of a batch of words, one matrix of weights and of piece numbers per length of arc."""

    def __init__(self, pieces: Pieces, weights: Weights, words: list[str]):
        self.pieces, self.weights = pieces, weights
        codes = [np.frombuffer((BEGIN + w).encode("utf-32-le", "surrogatepass"), dtype="<u4") for w in words]
        self.sizes = np.array([len(c) for c in codes])
        width = int(self.sizes.max())
        self.codes = np.zeros((len(words), width), dtype=np.int64)
        for row, code in enumerate(codes):
            self.codes[row, : len(code)] = code
        self.numbers = []
        row, at = np.nonzero(np.arange(width) < self.sizes[:, None])
        node = np.zeros(len(row), dtype=np.int64)
        for length in range(1, min(pieces.longest, width) + 1):
            inside = at + length <= self.sizes[row]
            row, at, node = row[inside], at[inside], node[inside]
            key = node << SHIFT | self.codes[row, at + length - 1]
            edge = np.minimum(np.searchsorted(pieces.keys, key), len(pieces.keys) - 1)
            known = pieces.keys[edge] == key
            row, at, edge = row[known], at[known], edge[known]
            if not len(row):
                break
            node = pieces.child[edge]
            number = np.full(self.codes.shape, -1, dtype=np.int32)
            number[row, at] = pieces.piece[edge]
            self.numbers.append(number)
        # The last entry stands for no piece.
        table = np.append(weights.piece, -np.inf)
        self.arcs = [table[number] for number in self.numbers]
        self._spell()

    def _spell(self) -> None:
        """``self.spelt``: the weight of every character's bytes; the first one begins the word as nothing else does."""
        letters, where = np.unique(self.codes, return_inverse=True)
        table = self.weights.piece[self.pieces.bytes]
        self.letters = [list(chr(c).encode("utf-8", "surrogatepass")) for c in letters.tolist()]
        self.where = where.reshape(self.codes.shape)
        self.spelt = np.array([table[b].sum() for b in self.letters])[self.where]

    def forward(self) -> np.ndarray:
        """log P of every prefix of every word, summed over its segmentations."""
        alpha = np.full((len(self.codes), self.codes.shape[1] + 1), -np.inf)
        alpha[:, 0] = 0.0
        for end in range(1, alpha.shape[1]):
            total = alpha[:, end - 1] + self.spelt[:, end - 1]
            for length in range(1, min(end, len(self.arcs)) + 1):
                total = np.logaddexp(total, alpha[:, end - length] + self.arcs[length - 1][:, end - length])
            alpha[:, end] = total
        return alpha

    def backward(self) -> np.ndarray:
        """log P of every suffix."""
        width = self.codes.shape[1]
        beta = np.full((len(self.codes), width + 1), -np.inf)
        beta[np.arange(len(self.codes)), self.sizes] = 0.0
        for start in range(width - 1, -1, -1):
            total = np.logaddexp(beta[:, start], beta[:, start + 1] + self.spelt[:, start])
            for length in range(1, min(width - start, len(self.arcs)) + 1):
                total = np.logaddexp(total, beta[:, start + length] + self.arcs[length - 1][:, start])
            beta[:, start] = np.where(start < self.sizes, total, beta[:, start])
        return beta

    def probabilities(self) -> np.ndarray:
        """log P of every word, with its stop."""
        return self.forward()[np.arange(len(self.codes)), self.sizes] + self.weights.stop

    def uses(self, counts: np.ndarray) -> np.ndarray:
        """Expected uses of every piece in words that occur ``counts`` times."""
        alpha, beta = self.forward(), self.backward()
        whole = beta[:, :1]
        out = np.zeros(len(self.weights.piece))
        for length, (number, arc) in enumerate(zip(self.numbers, self.arcs, strict=True), 1):
            row, at = np.nonzero(number >= 0)
            share = np.exp(alpha[row, at] + arc[row, at] + beta[row, at + length] - whole[row, 0])
            out += np.bincount(number[row, at], share * counts[row], minlength=len(out))
        row, at = np.nonzero(np.arange(self.codes.shape[1]) < self.sizes[:, None])
        share = np.exp(alpha[row, at] + self.spelt[row, at] + beta[row, at + 1] - whole[row, 0]) * counts[row]
        by_letter = np.bincount(self.where[row, at], share, minlength=len(self.letters))
        for letter, n in zip(self.letters, by_letter.tolist(), strict=True):
            if n:
                np.add.at(out, self.pieces.bytes[letter], n)
        return out


def batches(words: list[str], cells: int = CELLS):
    """Places of words in groups of like length."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    group: list[int] = []
    for i in order:
        if group and (len(group) + 1) * (len(words[i]) + 1) > cells:
            yield group
            group = []
        group.append(i)
    if group:
        yield group
