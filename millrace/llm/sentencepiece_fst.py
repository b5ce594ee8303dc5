"""SentencePiece encoding and decoding by weighted finite-state transducers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .durable import small_batches
from .rowkeys import keyed

SPACE = "▁"
_INFINITY = float("inf")
#: Words whose shortest path a task remembers at most, new ones and, as many again, those of before that are still met.
REMEMBERED = 100_000
#: Pairs of pieces whose place in the grammar a task remembers at most.
PAIRS = 400_000


@dataclass(frozen=True)
class Spec:
    """What is read of a model file."""

    pieces: tuple[tuple[str, float], ...]
    kinds: tuple[int, ...]  # 1 normal, 2 unknown, 3 control, 4 defined by the user, 5 unused, 6 byte
    merges: bool  # a BPE model: scores are the order of merges; else a unigram model: scores are log probabilities
    byte_fallback: bool
    dummy_prefix: bool
    squeeze_spaces: bool


def read_spec(data: bytes) -> Spec:
    """Reads a serialised model whose normaliser only marks spaces; one with a character map is refused, as no such map is at hand to test with."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(data)
    if m.normalizer_spec.precompiled_charsmap or not m.normalizer_spec.escape_whitespaces or m.trainer_spec.model_type not in (1, 2):
        raise ValueError("only unigram and BPE models with an identity normaliser are supported")
    return Spec(
        tuple((p.piece, p.score) for p in m.pieces), tuple(p.type for p in m.pieces), m.trainer_spec.model_type == 2,
        m.trainer_spec.byte_fallback, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces,
    )


class Normaliser:
    """The normaliser as a sequential transducer over characters.

    States: start, after a space, inside. A space is read as the mark; of spaces in a row only the first is written,
    and none at the start, if spaces are squeezed; the first character may write a mark in front of itself. All
    other arcs copy their character. Runs that stay in a state are followed at once.
    """

    START, SPACED, INSIDE = range(3)

    def __init__(self, dummy_prefix: bool, squeeze: bool):
        front = SPACE if dummy_prefix else ""
        #: (state, whether a space is read): the state that follows and what is written; a copied character is written behind it.
        self.arcs = {
            (self.START, False): (self.INSIDE, front),
            (self.START, True): (self.START, "") if squeeze else (self.INSIDE, front + SPACE),
            (self.INSIDE, False): (self.INSIDE, ""),
            (self.INSIDE, True): (self.SPACED, "") if squeeze else (self.INSIDE, SPACE),
            (self.SPACED, False): (self.INSIDE, SPACE),
            (self.SPACED, True): (self.SPACED, ""),
        }

    def apply(self, text: str) -> str:
        if not text:
            return ""
        state, written = self.arcs[self.START, text[0] == " "]
        out = [written, "" if text[0] == " " else text[0]]
        if self.arcs[self.INSIDE, True][0] == self.INSIDE == state:  # all arcs loop here, so the state is a map of characters
            return "".join(out) + text[1:].replace(" ", self.arcs[self.INSIDE, True][1])
        for run in re.findall(" +|[^ ]+", text[1:]):
            state, written = self.arcs[state, run[0] == " "]
            out += (written, "" if run[0] == " " else run)  # a second space of a run writes nothing more
        return "".join(out)


Arc = tuple[str, float, tuple[int, ...]]


class Transducer:
    """Normaliser, pieces, byte fallback and, for a BPE model, the grammar of its merges, composed with an input.

    The pieces form a trie over characters: a path from its root to a piece is an arc that reads the piece and
    writes its id, and a character that is no piece has an arc that writes its bytes (or the unknown piece).
    Weights are of the tropical semiring: a path's weight is the sum of its arcs', the best one the least.

    For a unigram model an arc weighs the piece's negative log probability. A BPE model's scores are the order of
    its merges and no sums, so there every arc weighs one and the pieces are composed with a grammar: its state is
    the piece before, and a pair of pieces is an arc of it, of weight zero, where merging the characters of both leaves
    just these two; any other pair has the weight infinity. Merges never cross the pieces of a result, and a wrong
    border always shows on some pair beside it, so exactly one path of the composition has a finite weight.
    """

    def __init__(self, spec: Spec):
        self.spec = spec
        self.normaliser = Normaliser(spec.dummy_prefix, spec.squeeze_spaces)
        usable = [i for i, k in enumerate(spec.kinds) if k in (1, 4)]
        self.scores = {spec.pieces[i][0]: spec.pieces[i][1] for i in usable}
        self.unknown = spec.kinds.index(2)
        self.bytes = [next((i for i, (p, _) in enumerate(spec.pieces) if spec.kinds[i] == 6 and p == f"<0x{b:02X}>"), self.unknown) for b in range(256)]
        self.surfaces = [_surface(p, k) for (p, _), k in zip(spec.pieces, spec.kinds, strict=True)]
        self.trie: dict = {}
        for i in usable:
            piece, score = spec.pieces[i]
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = (piece, 1.0 if spec.merges else -score, (i,))
        #: Number of each character that pieces use (0: none does), and which may stand next to which inside a piece.
        letters = {c: i for i, c in enumerate(dict.fromkeys(c for p in self.scores for c in p), 1)}
        self.letter = np.zeros(0x110000, np.uint16)
        self.letter[[ord(c) for c in letters]] = list(letters.values())
        self.joined = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for p in self.scores:
            for x, y in zip(p, p[1:]):
                self.joined[letters[x], letters[y]] = True
        self.unknown_weight = 1.0 if spec.merges else 10.0 - min(self.scores.values(), default=0.0)
        self._pairs: dict[tuple[str, str], bool] = {}
        self._known: dict[str, tuple[int, ...]] = {}
        self._before: dict[str, tuple[int, ...]] = {}

    def _fallback(self, c: str) -> Arc:
        """The arc of a character that is no piece."""
        ids = tuple(self.bytes[b] for b in c.encode("utf-8", "replace")) if self.spec.byte_fallback else (self.unknown,)
        return c, self.unknown_weight, ids

    def _merged(self, text: str) -> list[str]:
        """What the merges leave of a short string: the best pair first, of equal ones the leftmost."""
        parts = list(text)
        while True:
            best = min(((-self.scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.scores), default=None)
            if best is None:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _follows(self, a: str, b: str) -> bool:
        """Whether the grammar has the pair; each is worked out once."""
        if len(self._pairs) >= PAIRS:
            self._pairs.clear()
        got = self._pairs[a, b] = self._merged(a + b) == ([a, b] if a else [b])
        return got

    def _shortest(self, text: str) -> list[Arc]:
        """Tropical shortest path, position by position; of equal paths the first stays.

        The grammar of a unigram model has one state. That of a BPE model has many, but only one of them has a finite
        weight at each position: the last piece that the merges leave of the text before it. So the best weight and the arc that
        brought it are kept once a position, and an arc into a position that has its path is not tried.
        """
        merges, pairs, root, n = self.spec.merges, self._pairs, self.trie, len(text)
        best = [_INFINITY] * (n + 1)
        best[0] = 0.0
        came: list[Arc] = [("", 0.0, ())] * (n + 1)
        for at in range(n):
            here = best[at]
            if here == _INFINITY:
                continue
            before, node, k, single = came[at][0], root, at, False
            while True:  # along the trie; a character that is no piece has its arc last
                node = node.get(text[k]) if k < n else None
                if node is None:
                    if single:
                        break
                    arc, to, single = self._fallback(text[at]), at + 1, True
                else:
                    k += 1
                    arc, to = node.get(""), k
                    if arc is None:
                        continue
                    single |= to == at + 1
                if merges:
                    if best[to] == _INFINITY:
                        ok = pairs.get((before, arc[0]))
                        if self._follows(before, arc[0]) if ok is None else ok:
                            best[to], came[to] = here + 1.0, arc
                elif here + arc[1] < best[to]:
                    best[to], came[to] = here + arc[1], arc
                if node is None:
                    break
        path, at = [], n
        while at:
            path.append(came[at])
            at -= len(came[at][0])
        return path[::-1]

    def _emitted(self, text: str) -> tuple[int, ...]:
        """What the shortest path writes; unknown pieces in a row are one."""
        ids = [i for _, _, written in self._shortest(text) for i in written]
        if self.spec.byte_fallback:
            return tuple(ids)
        return tuple(i for k, i in enumerate(ids) if i != self.unknown or not k or ids[k - 1] != i)

    def _stretches(self, text: str) -> list[str]:
        """The text cut wherever no piece holds the two characters beside the cut: no path crosses there, so each part stands for itself."""
        numbers = self.letter[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        cuts = np.flatnonzero(~self.joined[numbers[:-1], numbers[1:]]) + 1
        edges = [0, *cuts.tolist(), len(text)]
        return [text[a:b] for a, b in zip(edges, edges[1:])]

    def encode(self, text: str) -> list[int]:
        """Ids of the shortest path through the composition of normaliser, pieces and byte fallback with the text."""
        marked = self.normaliser.apply(text)
        if not marked:
            return []
        if not self.spec.byte_fallback:  # unknown characters in a row are one, so they must meet
            return list(self._emitted(marked))
        known = self._known
        stretches = self._stretches(marked)
        out = [known.get(s) for s in stretches]
        if None in out:
            for k, got in enumerate(out):
                if got is None:
                    s = stretches[k]
                    out[k] = got = known.get(s) or self._before.get(s) or self._emitted(s)
                    if len(s) <= 64:
                        if len(known) >= REMEMBERED:
                            self._before, self._known = known, {}
                            known = self._known
                        known[s] = got
        return list(chain.from_iterable(out))

    def forget(self) -> None:
        """Drops the remembered words, so that a worker that waits for other tasks holds none."""
        self._known, self._before = {}, {}
        pa.default_memory_pool().release_unused()

    def decode(self, ids: list[int]) -> str:
        """The inverse transducer: pieces to text, runs of byte pieces to the characters they spell."""
        text = b"".join(map(self.surfaces.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.spec.dummy_prefix and ids and text.startswith(" ") and self.spec.pieces[ids[0]][0].startswith(SPACE) else text


def _surface(piece: str, kind: int) -> bytes:
    """What a piece decodes to: its byte, nothing for a control piece, a mark for the unknown piece, else its text."""
    return bytes([int(piece[3:5], 16)]) if kind == 6 else b"" if kind == 3 else " \u2047 ".encode() if kind == 2 else piece.replace(SPACE, " ").encode()


@lru_cache(maxsize=2)
def _transducer(data: bytes) -> Transducer:
    return Transducer(read_spec(data))


_RESULT = T.StructType([T.StructField("doc", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


def _coded(data: bytes, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _transducer(data)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [machine.encode(t or "") for t in part.column("text").to_pylist()]
                edges = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(edges[-1])))
                texts = pa.array([machine.decode(x) if with_text else None for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.ListArray.from_arrays(pa.array(edges), flat), texts], names=_RESULT.names)
        machine.forget()

    return run


def encode_texts(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Rows (id, ids, decoded): the piece ids of each whole text, and the text they decode to.

    No shuffle; the model file's bytes (of fixed size) travel with the tasks and are compiled once in each.
    Null and empty texts have no ids and decode to the empty text. A text decodes to itself, except that the
    mark U+2581 becomes a space. Rows that repeat an id with the same text are one row. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    texts, key = keyed(docs, id_col, text_col)
    out = texts.select("doc", "text").mapInArrow(_coded(model, with_text), _RESULT)
    if key is not None:
        out = out.join(key, "doc").drop("doc").withColumnRenamed("id", "doc")
    return out.select(F.col("doc").alias(id_col), "ids", "decoded")


def model_bytes(path: str | None = None) -> bytes:
    """The model file, read on the driver; by default the public 32k model of the installed tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_texts(docs, model_bytes()).select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
