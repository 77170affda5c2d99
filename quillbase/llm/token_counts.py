"""Operator 1, token counts: unigram segmentation with forward scores shared along a trie.

A pre-token is one space and a maximal run of bytes other than ASCII white space. Its tokens are the pieces of
the best segmentation under a unigram model; pieces are the entries of a public rank file, and the probability
of rank r is by Zipf's law 1 / (r + 1) over the harmonic sum. Scores are whole millionths of a nat, so equal
scores are exact ties; of them the segmentation with fewer tokens counts.

Forward scores depend on the prefix alone. Distinct pre-tokens are therefore inserted in a trie whose nodes hold
the best score and token count of their prefix: each shared prefix is scored once, and the terminal node of a
pre-token has its count. The trie and the table of terminal counts belong to one task and are emptied when they
reach a fixed number of nodes, so memory is bounded while results stay the same. The probabilities are given, not
learnt from the table: a fit would double the passes over all texts.

A very long pre-token takes time in proportion to its length. Null texts and texts without words have no tokens; ids may be null or repeated, rows are never merged; columns
other than those asked for are dropped, and one asked for with the name of a result gives way to it. An empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import math

from pyspark.sql import DataFrame, SparkSession

from .common import per_document, table

MAX_NODES = 600_000
MAX_WORDS = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def unigram_scores(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """Millionths of a nat for each piece."""
    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {piece: round(-1e6 * (math.log(r + 1) + total)) for piece, r in ranks.items()}


class PieceTrie:
    """A trie of pre-tokens with the best forward score and token count at each node."""

    def __init__(self, scores: dict[bytes, int]):
        self.scores = scores
        # every end of a piece: where none fits, no longer piece does
        self.tails = {piece[i:] for piece in scores for i in range(len(piece))}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best = [0]
        self.count = [0]

    def insert(self, word: bytes) -> tuple[int, int]:
        """(tokens, score) of the best segmentation."""
        child, best, count, scores, tails = self.child, self.best, self.count, self.scores, self.tails
        path, node = [0], 0
        for end, byte in enumerate(word, 1):
            key = node << 8 | byte
            after = child.get(key)
            if after is None:
                top, least = None, 0
                for start in range(end - 1, -1, -1):
                    piece = word[start:end]
                    score = scores.get(piece)
                    if score is None:
                        if piece not in tails:
                            break
                    else:
                        score += best[path[start]]
                        n = count[path[start]] + 1
                        if top is None or score > top or score == top and n < least:
                            top, least = score, n
                after = child[key] = len(best)
                best.append(top)
                count.append(least)
            node = after
            path.append(node)
        return count[node], best[node]


class _Words(dict):
    """Terminal counts by word, looked up in the trie when new."""

    def __init__(self, trie: PieceTrie):
        super().__init__()
        self.trie = trie

    def __missing__(self, word: bytes) -> tuple[int, int]:
        found = self.trie.insert(b" " + word)
        if len(self.trie.best) > MAX_NODES:
            self.trie.clear()
        if len(self) < MAX_WORDS:
            self[word] = found
        return found


def with_token_counts(df: DataFrame, ranks_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns n_bytes, n_pretokens, n_tokens and score (millionths of a nat) for each row."""

    def make():
        words = _Words(PieceTrie(unigram_scores(load_ranks(ranks_path))))

        def call(texts):
            rows = []
            for text in texts:
                data = (text or "").encode()
                split = data.split()
                if len(words) >= MAX_WORDS:
                    words.clear()
                found = list(map(words.__getitem__, split))
                rows.append((len(data), len(split), sum(f[0] for f in found), sum(f[1] for f in found)))
            return list(zip(*rows, strict=True)) if rows else [[], [], [], []]

        return call

    return per_document(df, make, "n_bytes long, n_pretokens long, n_tokens long, score long", text_col, keep)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return with_token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
