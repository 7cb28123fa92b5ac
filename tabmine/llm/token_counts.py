"""Token counts under a unigram tokenizer, without making the tokens.

A text becomes segments that begin at each space (written as the meta symbol, also put before the
text). In a segment an Aho-Corasick automaton lists every vocabulary piece at every place, and dynamic
programming over end positions carries the best score and the number of pieces on that path. Ties are
those of the tokenizers library: a path replaces another that ends at the same place only if its score
is larger, and starts are tried from the left, so of equal paths the one with the longest last piece
stays. A character without a piece of its own costs the least score minus 10; such characters become
their UTF-8 bytes' pieces if the vocabulary has them all, else runs of them count as one unknown piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from math import inf, log

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tabmine.llm.common import each_batch, id_and_text

META = "▁"
UNKNOWN_PENALTY = 10.0


def vocabulary(model_path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file, for a unigram model over its pieces.

    The file's own scores are merge ranks; as log probabilities they are turned into -ln(rank + 1) by
    rule (Zipf), rank being the place in the file. As in the library, text that spells out any piece matches it; the control pieces and
    the unknown piece have score 0.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    plain = lambda k: not (model.is_control(k) or model.is_unknown(k))
    return [(model.id_to_piece(k), -log(k + 1) if plain(k) else 0.0) for k in range(model.get_piece_size())]


class Counter:
    """Counts pieces of texts; counts of segments are kept in a bounded cache."""

    def __init__(self, vocab: list[tuple[str, float]], cache: int = 400_000):
        self.bytes = {f"<0x{b:02X}>" for b in range(256)} & {p for p, _ in vocab}
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.worst = min((s for _, s in vocab), default=0.0) - UNKNOWN_PENALTY
        self.limit, self.known = cache, {}

    def segment(self, s: str) -> int:
        """Pieces of one segment. Of the pieces with one end the automaton yields the longest first."""
        n = len(s)
        score, count, single = [0.0] + [-inf] * n, [0] * (n + 1), 0
        matches = list(self.automaton.iter(s)) if len(self.automaton) else []
        for last, (size, x) in matches:
            at = last + 1 - size
            single += size == 1
            if (total := score[at] + x) > score[last + 1]:
                score[last + 1], count[last + 1] = total, count[at] + 1
        return count[n] if single == n else self._with_unknown(s, matches)

    def _with_unknown(self, s: str, matches: list) -> int:
        """The same where some character has no piece; run[e] is where the unknown run that ends at e began."""
        n, k = len(s), 0
        score, count, run = [0.0] + [-inf] * n, [0] * (n + 1), [-1] * (n + 1)
        for e in range(1, n + 1):
            single = False
            while k < len(matches) and matches[k][0] == e - 1:
                size, x = matches[k][1]
                k += 1
                single |= size == 1
                if (total := score[e - size] + x) > score[e]:
                    score[e], count[e] = total, count[e - size] + 1
            if not single and (total := score[e - 1] + self.worst) > score[e]:
                run[e] = e - 1 if run[e - 1] < 0 else run[e - 1]
                score[e], count[e] = total, count[run[e]] + self._unknown(s[run[e] : e])
        return count[n]

    def _unknown(self, run: str) -> int:
        """Pieces of a run of unknown characters: its bytes if all have pieces, else one."""
        raw = run.encode("utf-8", "surrogatepass")
        return len(raw) if all(f"<0x{b:02X}>" in self.bytes for b in raw) else 1

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        parts = text.replace(META, " ").split(" ")
        for part in parts if parts[0] else parts[1:]:  # a text that begins with a space needs no other
            n = known.get(part)
            if n is None:
                n = self.segment(META + part)
                if len(known) >= self.limit:
                    known.clear()
                if len(part) <= 64:
                    known[part] = n
            total += n
        return total


_counters: dict[str, Counter] = {}


def counts(spark: SparkSession, docs: DataFrame, vocab: list[tuple[str, float]]) -> DataFrame:
    """(doc_id, n_tokens) of every row's whole text.

    Null and empty texts have 0 tokens; a text that is one space is one segment, the meta symbol
    alone; null ids stay null; repeated rows give repeated rows, an empty table none; texts of any length are
    counted whole; paths of equal score count as the tokenizers library breaks the tie, for the longest last
    piece; other columns are ignored, whatever their names.
    """
    shared, name = spark.sparkContext.broadcast(vocab), sha256(repr(vocab).encode()).hexdigest()
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _counters:  # a worker keeps one counter, with its cache, for its next tasks
            _counters.clear()
            _counters[name] = Counter(shared.value)
        count = _counters[name]
        for batch in each_batch(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([count(t) for t in batch.column(1).to_pylist()], pa.int64())], schema=out
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long")
