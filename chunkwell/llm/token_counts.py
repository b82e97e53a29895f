"""Token counts of a unigram tokenizer, computed once per shared prefix of pre-tokens.

Texts are split into pre-tokens by a fixed pattern. The distinct pre-tokens of a batch are
put into a trie; a forward pass over it keeps, for every node, the best score of any split
of the path so far into vocabulary pieces and its number of pieces. A prefix that many
pre-tokens share is scored once, and where a pre-token ends the count is read off.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Mapping

import numpy as np
import regex
from pyspark.sql import DataFrame

from chunkwell.llm.common import map_texts

#: The pattern by which the public byte-level vocabularies split texts.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Counts a task remembers between batches; beyond that it starts anew.
REMEMBERED = 300_000
#: Characters of a text that are split at a time, so that a huge text makes no huge list.
_PIECE = 1 << 20

# Scores are compared as whole numbers, so that sums do not depend on their order.
_SCALE = 1 << 20


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The pieces of a public vocabulary file in the order of their ranks."""
    with open(path, "rb") as lines:
        ranked = [line.split() for line in lines if line.strip()]
    ranked.sort(key=lambda pair: int(pair[1]))
    return [base64.b64decode(piece) for piece, _ in ranked]


def unigram_scores(pieces: list[bytes]) -> dict[bytes, int]:
    """Log-probabilities by Zipf's law, ``-ln(rank + 256)``, as whole numbers.

    The vocabulary is taken as it is; ranks stand for frequencies. Single bytes are added
    behind the last rank if they are missing, so every text can be split.
    """
    known = set(pieces)
    ranked = pieces + [bytes([b]) for b in range(256) if bytes([b]) not in known]
    scores: dict[bytes, int] = {}
    for rank, piece in enumerate(ranked):
        scores.setdefault(piece, -int(round(_SCALE * float(np.log(rank + 256)))))
    return scores


class TrieCounter:
    """Counts pieces of pre-tokens; the trie is walked in sorted order, so only one path is held."""

    def __init__(self, scores: Mapping[bytes, int]):
        self.scores = scores
        self.longest = max(map(len, scores))

    def counts(self, pretokens: list[bytes]) -> dict[bytes, int]:
        """``{pre-token: pieces}``; of equally good splits the one with fewer pieces counts."""
        found: dict[bytes, int] = {}
        get, longest = self.scores.get, self.longest
        path = b""
        best, pieces = [0], [0]  # per node of the path
        for word in sorted(set(pretokens)):
            shared = 0
            most = min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :], pieces[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, fewest = None, 0
                for start in range(max(0, end - longest), end):
                    score = get(word[start:end])
                    if score is not None:
                        score += best[start]
                        if top is None or score > top or (score == top and pieces[start] + 1 < fewest):
                            top, fewest = score, pieces[start] + 1
                best.append(top)
                pieces.append(fewest)
            path = word
            found[word] = pieces[-1]
        return found


def count_tokens(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id, n_pretokens, n_tokens, n_bytes)``, one row per input row.

    NULL and empty texts have no tokens. Repeated rows stay; other columns are not read. A
    text is counted where it is read, without a shuffle. Each task reads nothing but the
    scores, which are as large as the vocabulary; it remembers ``REMEMBERED`` pre-tokens at
    most, and forgetting costs time, not results.
    """
    scores = docs.sparkSession.sparkContext.broadcast(unigram_scores(read_vocabulary(vocabulary)))

    def setup():
        split, counter = regex.compile(PATTERN), TrieCounter(scores.value)
        known: dict[str, int] = {}

        def count(texts: list[str]) -> dict[str, list]:
            nonlocal known
            out: dict[str, list] = {"n_pretokens": [], "n_tokens": [], "n_bytes": []}
            group: list[tuple[int, Counter]] = []
            for k, text in enumerate(texts):
                out["n_pretokens"].append(0)
                out["n_tokens"].append(0)
                out["n_bytes"].append(len(text.encode("utf-8", "surrogatepass")))
                for part in pieces_of(text):
                    words = Counter(split.findall(part))
                    out["n_pretokens"][k] += words.total()
                    group.append((k, words))
                    if len(group) >= 256:
                        settle(group, out["n_tokens"])
                        group = []
            settle(group, out["n_tokens"])
            return out

        def settle(group: list[tuple[int, Counter]], totals: list[int]) -> None:
            nonlocal known
            new = {w for _, words in group for w in words if w not in known}
            if len(known) + len(new) > REMEMBERED:
                known = {}
                new = {w for _, words in group for w in words}
            coded = {w: w.encode("utf-8", "surrogatepass") for w in new}
            made = counter.counts(list(coded.values()))
            known.update((w, made[b]) for w, b in coded.items())
            for k, words in group:
                totals[k] += sum(known[w] * n for w, n in words.items())

        return count

    return map_texts(docs, id_col, text_col, "n_pretokens bigint, n_tokens bigint, n_bytes bigint", setup)


def pieces_of(text: str) -> list[str]:
    """A text cut where a cut splits no pre-token: before a blank between two letters."""
    if len(text) <= _PIECE:
        return [text]
    parts, at = [], 0
    while len(text) - at > _PIECE:
        cut = at + _PIECE
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha()):
            cut += 1
        parts.append(text[at:cut])
        at = cut
    return parts + [text[at:]]
