"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is marked (spaces become U+2581, one more goes in front) and cut before each run of marks; no piece of the
vocabulary has a mark after another character, so words never interact. The distinct marked words of a block of texts are
sorted and walked depth-first as a trie: the forward scores of a common prefix are computed once. A state holds, for a
prefix of the word, the best score of a segmentation, its last piece and where that starts. The pieces that can end a prefix
are listed by an Aho-Corasick automaton over the vocabulary, so substrings that are no pieces are never looked up.

In a unigram vocabulary scores are log probabilities and every transition counts. In a merge (BPE) vocabulary scores are
merge ranks, whole numbers, and the sum of scores alone would not give the segmentation that its merges
give. There the lattice only has the transitions that merging allows: from piece a to piece b if merging the text ab
ends in exactly a, b. With them each prefix has one path, so the first is the best, and the ids equal those of the library. Whether a transition
is allowed is found by merging once and kept in a bounded table.

Characters outside the vocabulary become byte pieces. Decoding joins pieces and bytes and turns marks into spaces, so a
text comes back whole, except that U+2581 in it comes back as a space.

Nulls and odd input: null and empty texts have no pieces and decode to an empty text; repeated rows each get a row; an
empty table gives an empty result. Extra columns are ignored by ``piece_digests`` and kept by ``encoded_documents``
unless they are named like its own new columns, which take their place.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import blocks

MARK = "▁"
CACHE_WORDS = 600_000
CACHE_PAIRS = 500_000
_CUT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Pieces:
    """A vocabulary: ids and scores of pieces, and the ids of byte pieces."""

    def __init__(self, ids: dict[str, int], scores: dict[str, float], byte_ids: dict[int, int]):
        self.ids, self.scores, self.bytes = ids, scores, byte_ids
        self.merges = all(float(x).is_integer() for x in scores.values())
        #: Of a character without a piece, as in the library: below every piece.
        self.unknown = min(scores.values()) - 10.0
        self.codes = {p: i.to_bytes(2, "little") for p, i in self.ids.items()}
        self.text = [b""] * (1 + max(*ids.values(), *byte_ids.values()))
        for p, i in self.ids.items():
            self.text[i] = p.replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            self.text[i] = bytes([b])
        self.machine = self.automaton()
        self.ok: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> Pieces:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        if n > 1 << 16:
            raise ValueError(f"{n} pieces do not fit 16 bits")
        ids = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        return cls(ids, {p: sp.get_score(i) for p, i in ids.items()}, {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)})

    def merged(self, text: str) -> list[str]:
        """The pieces that merging gives: always the adjacent pair whose whole has the best score, the leftmost first."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def allowed(self, a: str, b: str) -> bool:
        found = self.ok.get((a, b))
        if found is None:
            if len(self.ok) >= CACHE_PAIRS:
                self.ok.clear()
            found = self.ok[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return found

    def automaton(self) -> tuple[list[dict[str, int]], list[int], list[tuple[tuple[str, int, float], ...]]]:
        """Aho-Corasick states, one for each prefix of a piece: the next states by character, the state of the longest proper
        suffix that is one too, and the pieces that end here, longest first, as (piece, length, score). A last character
        that is no piece counts as one with the score of unknown ones."""
        scores, step, back, ending = self.scores, [{}], [0], [()]
        for piece in scores:
            state = 0
            for ch in piece:
                if ch not in step[state]:
                    step[state][ch] = len(step)
                    step.append({})
                    back.append(0)
                    ending.append(())
                state = step[state][ch]
            ending[state] = ((piece, len(piece), scores[piece]),)
        level = [(0, ch, s) for ch, s in step[0].items()]
        while level:
            for parent, ch, state in level:
                if parent:
                    shorter = back[parent]
                    while shorter and ch not in step[shorter]:
                        shorter = back[shorter]
                    back[state] = step[shorter].get(ch, 0)
                    ending[state] += ending[back[state]]
                if ch not in scores and (not ending[state] or ending[state][-1][1] > 1):
                    ending[state] += ((ch, 1, self.unknown),)
            level = [(state, ch, s) for _, _, state in level for ch, s in step[state].items()]
        return step, back, ending

    def walk(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each of the sorted ``words`` with its ids, depth-first: for each prefix of the current word, ``forward`` has the
        best score, ``last`` its last piece, ``froms`` where that starts and ``states`` the automaton's state; all are cut back
        to what the next word shares."""
        forward, last, froms, states = [0.0], [""], [0], [0]
        before, merges, allowed, code, unknown = "", self.merges, self.allowed, self.code, self.unknown
        step, back, ending = self.machine
        ok = self.ok
        for word in words:
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del forward[shared + 1 :], last[shared + 1 :], froms[shared + 1 :], states[shared + 1 :]
            state = states[shared]
            for end, ch in enumerate(word[shared:], shared + 1):
                while ch not in step[state] and state:
                    state = back[state]
                state = step[state].get(ch, 0)
                score = None
                for piece, n, own in ending[state] if state else ((ch, 1, unknown),):
                    start = end - n
                    if merges:
                        pair = last[start], piece
                        good = ok.get(pair)
                        if allowed(*pair) if good is None else good:
                            score, best, origin = forward[start] + own, piece, start
                            break
                    elif score is None or forward[start] + own > score:
                        score, best, origin = forward[start] + own, piece, start
                forward.append(score)
                last.append(best)
                froms.append(origin)
                states.append(state)
            before = word
            path, end = [], len(word)
            while end:
                path.append(code(last[end]))
                end = froms[end]
            path.reverse()
            yield word, b"".join(path)

    def code(self, piece: str) -> bytes:
        return self.codes.get(piece) or b"".join([self.bytes[b].to_bytes(2, "little") for b in piece.encode()])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 16-bit integers."""
        cut = []
        for t in texts:
            if not t:
                cut.append(None)
            elif "  " in t or MARK in t or t[0] == " " or t[-1] == " ":
                cut.append(_CUT.findall(MARK + t.replace(" ", MARK)))
            else:
                cut.append([MARK + w for w in t.split(" ")])
        known = self.words
        new = {w for c in cut if c for w in c if w not in known}
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = {w for c in cut if c for w in c}
        known.update(self.walk(sorted(new)))
        return [b"".join([known[w] for w in c]) if c else b"" for c in cut]

    def decode(self, ids: np.ndarray) -> str:
        text = self.text
        return b"".join([text[i] for i in ids.tolist()]).decode("utf-8", "replace")[1:]


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One per worker process, so its tables outlive a task."""
    if path not in _LOADED:
        _LOADED[path] = Pieces.load(path)
    return _LOADED[path]


def _encoded(batches: Iterator[pa.RecordBatch], path: str, with_decoded: bool) -> Iterator[pa.RecordBatch]:
    p = pieces(path)
    for batch in batches:
        for b in blocks(batch):
            raw = p.encode(b.column("text").to_pylist())
            columns, names = [b.column(c) for c in b.schema.names], [*b.schema.names, "piece_ids"]
            ends = np.concatenate(([0], np.cumsum([len(r) // 2 for r in raw])))
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<u2").astype(np.int32))))
            if with_decoded:
                columns.append(pa.array([p.decode(np.frombuffer(r, "<u2")) for r in raw], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)


def encoded_documents(docs: DataFrame, model: str, with_decoded: bool = False) -> DataFrame:
    """``docs`` with ``piece_ids`` and, if asked for, with the text that they stand for in ``decoded``, in one pass."""
    new = {"piece_ids": F.lit(None).cast("array<int>")} | ({"decoded": F.lit("")} if with_decoded else {})
    d = docs.drop(*new)
    return d.mapInArrow(lambda batches: _encoded(batches, model, with_decoded), d.select("*", *[v.alias(k) for k, v in new.items()]).schema)


def _texts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    p = pieces(path)
    for b in batches:
        ids = b.column("piece_ids")
        flat = ids.values.to_numpy(zero_copy_only=False)
        spans = zip(ids.offsets.to_pylist(), ids.offsets.to_pylist()[1:])
        decoded = [p.decode(flat[a:z]) for a, z in spans]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in b.schema.names], pa.array(decoded, pa.string())], names=[*b.schema.names, "decoded"])


def decoded_documents(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` with the text that its ``piece_ids`` stand for in ``decoded``."""
    d = encoded.drop("decoded")
    return d.mapInArrow(lambda batches: _texts(batches, model), d.select("*", F.lit("").alias("decoded")).schema)


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, n_bytes (byte pieces), ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and
    round_trip (decoding gives the text, with U+2581 as a space)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        low, high = min(p.bytes.values()), max(p.bytes.values())
        for batch in batches:
            for b in blocks(batch):
                texts = b.column("text").to_pylist()
                ids = [np.frombuffer(r, "<u2") for r in p.encode(texts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([int(((x >= low) & (x <= high)).sum()) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                        pa.array([p.decode(x) == (t or "").replace(MARK, " ") for x, t in zip(ids, texts)], pa.bool_()),
                    ],
                    names=["doc_id", "n_pieces", "n_bytes", "ids_crc32", "round_trip"],
                )

    return docs.select("doc_id", "text").mapInArrow(digest, "doc_id long, n_pieces long, n_bytes long, ids_crc32 long, round_trip boolean")
