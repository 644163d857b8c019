"""Token counts under a unigram vocabulary, by dynamic programming shared along a trie.

Pre-tokens (white-space separated words with a leading word mark) go into a trie; each
node stores the best (Viterbi) forward score of its prefix and the number of pieces of
that best segmentation. A node is computed from its ancestors once, however many
pre-tokens share the prefix, and a terminal's count is then a look-up. A worker keeps its
trie across tasks and, between batches, starts a new one past ``MAX_NODES`` (a bound on memory;
counts don't depend on it). Nothing is shuffled and nothing comes to the driver.

The vocabulary is a public one, its file is a parameter; a piece's log score follows from
its rank by Zipf's law (-log(rank + 2)), characters outside the vocabulary cost
``UNKNOWN`` each and count as one token. Ties: the segmentation with fewer pieces wins.

Defined cases: null and empty texts count 0 tokens. Repeated rows each give their row. Very long
texts are looked at in one piece, others in slices of ``SLICE`` bytes. An empty table gives no rows.
Extra columns are ignored, whatever their names. Null ``doc_id`` stays null.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from typeloom.llm.common import kept_in_process, slices, strings, totals, word_codes

MARK = "▁"
UNKNOWN = -25.0
MAX_NODES = 1_500_000
#: Bytes of text that are looked at together.
SLICE = 4_000_000


def zipf_scores(model_file: str) -> tuple[dict[str, float], int]:
    """Log scores of a SentencePiece vocabulary's ordinary pieces by rank, and the longest piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    scores: dict[str, float] = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
            scores.setdefault(sp.id_to_piece(i), -math.log(len(scores) + 2))
    return scores, max(map(len, scores), default=1)


class Trie(dict):
    """Terminal counts by word, and forward scores of every prefix that was inserted.

    ``children`` maps a node and a character, packed in one number, to a node; ``score``
    and ``pieces`` have each node's best sum and its number of pieces. Node 0 is the empty prefix.
    """

    def __init__(self, scores: dict[str, float], longest: int):
        super().__init__()
        self.scores, self.longest = scores, longest
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.children: dict[int, int] = {}
        self.score, self.pieces = array("d", [0.0]), array("i", [0])
        self.computed = 0

    def __missing__(self, word: str) -> int:
        self[word] = n = self._insert(MARK + word)
        return n

    def _insert(self, token: str) -> int:
        path, node = [0], 0
        children, score, pieces, scores, longest = self.children, self.score, self.pieces, self.scores, self.longest
        for end, char in enumerate(token, 1):
            key = node << 21 | ord(char)
            child = children.get(key)
            if child is None:
                best, fewest = score[node] + UNKNOWN, pieces[node] + 1
                for start in range(max(0, end - longest), end):
                    own = scores.get(token[start:end])
                    if own is not None:
                        sum_, n = score[path[start]] + own, pieces[path[start]] + 1
                        if sum_ > best or (sum_ == best and n < fewest):
                            best, fewest = sum_, n
                child = children[key] = len(score)
                score.append(best)
                pieces.append(fewest)
                self.computed += 1
            node = child
            path.append(node)
        return pieces[node]


def count_tokens(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens (long): a row for each document."""
    kind = dict(docs.dtypes)["doc_id"]

    def counted(batches):
        trie = kept_in_process(f"trie of {model_file}", lambda: Trie(*zipf_scores(model_file)))
        for batch in batches:
            if len(trie.score) > MAX_NODES:
                trie.restart()
            for some in slices(batch, 1, SLICE):
                words, codes, starts = word_codes(some.column(1))
                full = np.asarray(pc.binary_length(words)) > 0
                each = np.array([trie[w] if w else 0 for w in strings(words)], dtype=np.int64)
                counts = [pa.array(totals(x[codes], starts)) for x in (full, each)]
                yield pa.RecordBatch.from_arrays([some.column(0), *counts], ["doc_id", "n_pretokens", "n_tokens"])

    texts = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("t"))
    return texts.mapInArrow(counted, f"doc_id {kind}, n_pretokens long, n_tokens long")

