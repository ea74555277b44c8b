"""Token counts by greedy longest match, without building the pieces.

The vocabulary is a trie. Every node has a failure link (where matching goes
on when no child fits) and the number of tokens that are complete by then, so
each character is looked at a bounded number of times and no piece is built.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from coppice.llm.textwork import built, map_batches, pick, texts

#: Marks the start of a word in the vocabulary.
START = "▁"


class LongestMatch:
    """Counts greedy longest-match pieces of words in linear time.

    A character that starts no piece counts as its UTF-8 bytes, as with byte
    fallback. Known word lengths are remembered up to ``remember`` words.
    """

    def __init__(self, pieces: list[str], remember: int = 300_000):
        self.remember, self.known = remember, {}
        children: list[dict[str, int]] = [{}]
        tokens = [0]  # of a node that is a piece, else 0
        order = [(0, 0, "")]  # node, parent, character; parents come first after sorting by depth
        depth = [0]

        def add(piece: str, count: int) -> None:
            node = 0
            for c in piece:
                if (after := children[node].get(c)) is None:
                    after = children[node][c] = len(children)
                    children.append({})
                    tokens.append(0)
                    depth.append(depth[node] + 1)
                    order.append((after, node, c))
                node = after
            tokens[node] = tokens[node] or count

        for piece in pieces:
            if piece:
                add(piece, 1)
        for c in {c for piece in pieces for c in piece}:
            add(c, len(c.encode()))
        link, popped = [0] * len(children), [0] * len(children)
        for node, parent, c in sorted(order[1:], key=lambda x: depth[x[0]]):
            if tokens[node]:
                popped[node] = tokens[node]
                continue
            done, z = popped[parent], link[parent]
            while c not in children[z]:  # every character is a child of the root
                done += popped[z]
                z = link[z]
            link[node], popped[node] = children[z][c], done
        self.children, self.link, self.popped = children, link, popped

    def count_word(self, word: str) -> int:
        children, link, popped = self.children, self.link, self.popped
        node = total = 0
        for c in word:
            while (after := children[node].get(c)) is None:
                if node == 0:  # a character outside the vocabulary
                    total += len(c.encode())
                    break
                total += popped[node]
                node = link[node]
            else:
                node = after
        while node:
            total += popped[node]
            node = link[node]
        return total

    def count(self, words: list[bytes]) -> int:
        known, total = self.known, 0
        for word in words:
            if (n := known.get(word)) is None:
                if len(known) >= self.remember:
                    known.clear()
                n = known[word] = self.count_word(START + word.decode("utf-8", "surrogatepass"))
            total += n
        return total


def vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def count_tokens(docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Greedy longest-match token counts of every whole text.

    Words are split at ASCII white space and start with the vocabulary's word
    mark. Returns one row per input row: ``doc_id``, ``n_chars``, ``n_words``,
    ``n_tokens``. A null or empty text counts 0. Repeated rows and null ids
    give a row each; other columns are not read. The vocabulary file is read
    by the driver and broadcast, its size does not depend on the input.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_path))

    def work(batch):
        match = built(pieces, LongestMatch)
        chars, words, tokens = [], [], []
        for text in texts(batch.column(1)):
            split = (text or b"").split()
            chars.append(len((text or b"").decode("utf-8", "surrogatepass")))
            words.append(len(split))
            tokens.append(match.count(split))
        yield {"doc_id": batch.column(0), "n_chars": pa.array(chars, pa.int64()),
               "n_words": pa.array(words, pa.int64()), "n_tokens": pa.array(tokens, pa.int64())}

    picked = pick(docs, doc_id=id_column, text=text_column)
    kind = picked.schema["doc_id"].dataType.simpleString()
    return map_batches(picked, work, f"doc_id {kind}, n_chars long, n_words long, n_tokens long")
