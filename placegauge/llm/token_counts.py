"""Word-piece token counts by a longest-match automaton that never builds the pieces.

A trie of the vocabulary; every node has a failure link to where matching goes on once the node
cannot be extended, and the number of tokens popped on that way, both computed before.  A word is
read once, byte by byte.  Pieces of a word are the longest vocabulary entries from left to right,
the first with the word's leading space, the others without.

Defined results: a null or empty text has no words and no tokens; repeated rows are counted row by
row; bytes that no entry begins with are one unknown token each.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from placegauge.llm.common import WORD_CACHE, arrow_rows, made_once, space_words
from placegauge.llm.tokens import byte_names, read_vocabulary

ROOT, REST = 0, 1  # before the first byte, and after a piece


def vocabulary_bytes(vocabulary: str) -> list[bytes]:
    """The entries of a byte-level vocabulary file as bytes; a leading space marks a word's start."""
    content = json.loads(vocabulary)
    back = {name: byte for byte, name in byte_names().items()}
    special = {token["content"] for token in content.get("added_tokens", ())}
    return [
        bytes(back[c] for c in name) for name in content["model"]["vocab"] if name not in special
    ]


class Automaton:
    """``count(word)``: number of pieces of one word."""

    def __init__(self, entries: list[bytes]) -> None:
        # step[node * 256 + byte] is the child.  A bare word start is a piece of its own.
        self.step: dict[int, int] = {}
        self.fail: list[int | None] = [REST, None]
        self.pops, self.depth, self.side, self.ends = [1, 0], [0, 0], [ROOT, REST], [True, False]
        self.known: dict[bytes, int] = {}
        parents: list[tuple[int, int]] = [(ROOT, 0), (REST, 0)]
        for entry in entries:
            top, body = (ROOT, entry[1:]) if entry[:1] == b" " else (REST, entry)
            if not body or b" " in body:
                continue
            node = top
            for byte in body:
                child = self.step.get(node * 256 + byte)
                if child is None:
                    child = self.step[node * 256 + byte] = len(parents)
                    parents.append((node, byte))
                    self.fail.append(None)
                    self.pops.append(0)
                    self.depth.append(self.depth[node] + 1)
                    self.side.append(top)
                    self.ends.append(False)
                node = child
            self.ends[node] = True
        # Failure links of shorter nodes first.
        for node in sorted(range(2, len(parents)), key=self.depth.__getitem__):
            self._link(node, *parents[node])

    def _link(self, node: int, parent: int, byte: int) -> None:
        if self.ends[node]:
            self.fail[node], self.pops[node] = REST, 1
            return
        at, popped = self.fail[parent], self.pops[parent]
        while at is not None and at * 256 + byte not in self.step:
            popped += self.pops[at]
            at = self.fail[at]
        if at is not None:
            self.fail[node], self.pops[node] = self.step[at * 256 + byte], popped

    def count(self, word: bytes) -> int:
        known = self.known.get(word)
        if known is None:
            if len(self.known) >= WORD_CACHE:
                self.known.clear()
            known = self.known[word] = self._run(word) if word else 0
        return known

    def _run(self, word: bytes) -> int:
        step, fail, pops = self.step, self.fail, self.pops
        tokens, node, at, size = 0, ROOT, 0, len(word)
        while at < size or node != REST:
            child = step.get(node * 256 + word[at]) if at < size else None
            if child is not None:
                node = child
                at += 1
            elif fail[node] is not None:
                tokens += pops[node]
                node = fail[node]
            else:
                # Some byte that follows begins no entry: take one piece, or that byte.
                tokens += 1
                at = self._piece(word, at - self.depth[node], self.side[node])
                node = REST
        return tokens

    def _piece(self, word: bytes, start: int, node: int) -> int:
        """End of the longest entry at ``start``; of one unknown byte if there is none."""
        end = start if node == ROOT else start + 1
        for at in range(start, len(word)):
            node = self.step.get(node * 256 + word[at])
            if node is None:
                break
            if self.ends[node]:
                end = at + 1
        return end


def automaton(vocabulary: str) -> Automaton:
    """The automaton of a vocabulary, made once in each Python worker."""
    return made_once("automaton", vocabulary, lambda text: Automaton(vocabulary_bytes(text)))


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        pieces = automaton(shared.value).count
        split = [space_words(text.as_py()) for text in batch["text"]]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array([len(words) for words in split], pa.int64()),
             pa.array([sum(map(pieces, words)) for words in split], pa.int64())],
            ["doc_id", "n_words", "n_tokens"],
        )

    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    return arrow_rows(rows, count, "doc_id bigint, n_words bigint, n_tokens bigint")
