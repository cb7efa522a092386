"""SentencePiece encoding of documents of any length by a max-plus scan over chunks.

A document is cut into chunks. At a cut the state is the piece that ends at it or lies across it. A chunk's transfer
matrix holds, for each state on its left and its right, the best score of the pieces between them, or minus infinity;
matrices combine by max-plus products, which are associative, and once the states on the best path are known every
chunk is traced back by itself. Products are combined in a tree over rounds, so no task holds a whole document.

For a unigram model a score is the sum of the pieces' scores. A BPE model picks no maximum, but its result is the one
sequence in which every two neighbours, joined and encoded, give themselves again; so a chunk scores zero if all
neighbours in it agree and minus infinity otherwise, and exactly one path is left. Between two states the pieces are
those that the library gives the text between them. Pieces never hold a space after another character, so a cut
before such a space has one state; other cuts are made only where no such space is near.
"""

from __future__ import annotations

import functools
import hashlib
import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, row_key, staged, text_batches, with_null_ids

CHUNK = 4_096
#: How far back from its end a chunk may be cut at a blank; elsewhere the cut has several states.
SEARCH = 8
_MODELS: dict = {}


class Model:
    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        self.pieces = {self.sp.id_to_piece(i): i for i in range(n) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i))}
        self.longest = max(map(len, self.pieces))
        self.spaces_lead = not any("▁" in p.lstrip("▁") for p in self.pieces)
        self.head = self.sp.encode("\n")
        self.unigram = self._is_unigram()
        self.agreed: dict = {}
        probe = "ﬁ  a　b"
        #: Normalisation that changes the text leaves no places to cut at.
        self.cuttable = self.sp.decode(self.sp.encode(probe)) == probe and "\n" not in "".join(self.pieces)

    def _is_unigram(self) -> bool:
        scores = [self.sp.get_score(i) for i in self.pieces.values()]
        return any(s != int(s) for s in scores[:2000])

    def inner(self, text: str) -> list[int]:
        """Ids of a text that others stand before: no blank is put in front."""
        return self.sp.encode("\n" + text)[len(self.head) :] if text else []

    def joined(self, ids: list[int], first: bool) -> str:
        return self.sp.decode(ids) if first else self.sp.decode([*self.head, *ids])[1:]

    def is_piece(self, text: str) -> bool:
        """One character, or a piece that encoding its own text gives back."""
        return len(text) == 1 or (text.replace(" ", "▁") in self.pieces and len(self.inner(text)) == 1)

    def agree(self, left: str, right: str) -> bool:
        """Whether the two pieces may stand side by side in a BPE result."""
        if self.unigram or not left or not right:
            return True
        key = (left, right)
        if key not in self.agreed:
            if len(self.agreed) > 200_000:
                self.agreed.clear()
            self.agreed[key] = self.inner(left + right) == self.inner(left) + self.inner(right) and len(self.inner(left + right)) >= 2
        return self.agreed[key]

    def score(self, ids: list[int]) -> float:
        return float(sum(self.sp.get_score(i) for i in ids)) if self.unigram else 0.0

    def split(self, ids: list[int], text: str) -> tuple[str, str]:
        """The first and the last piece of ``inner(text)``, as text."""
        first, last = self.sp.id_to_piece(ids[0]), self.sp.id_to_piece(ids[-1])
        return (text[0] if self.sp.is_byte(ids[0]) else text[: len(first)], text[-1] if self.sp.is_byte(ids[-1]) else text[-len(last) :])


def model(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def is_safe(text: str, at: int) -> bool:
    return 0 < at < len(text) - 1 and text[at] == " " and text[at - 1] not in " ▁" and text[at + 1] not in " ▁"


def cuts(text: str, m: Model, chunk: int = CHUNK, search: int = SEARCH) -> list[int]:
    """Places to cut, both ends included: before a lone space if one lies in the last ``search`` characters of a chunk."""
    out = [0]
    while m.cuttable and len(text) - out[-1] > chunk + search:
        want = out[-1] + chunk
        safe = want
        while m.spaces_lead and safe > want - search and not is_safe(text, safe):
            safe = text.rfind(" ", want - search, safe)
        out.append(safe if safe > want - search and is_safe(text, safe) and m.spaces_lead else want)
    return [*out, len(text)]


def states(text: str, cut: int, m: Model) -> list[tuple[int, int]]:
    """Pieces (begin, end) that end at the cut or lie across it; one empty piece where no piece can cross."""
    if cut in (0, len(text)) or (m.spaces_lead and is_safe(text, cut)):
        return [(cut, cut)]
    found = []
    for begin in range(max(0, cut - m.longest), cut):
        found += [(begin, end) for end in range(cut, min(len(text), begin + m.longest) + 1) if m.is_piece(text[begin:end])]
    return found


def between(text: str, left: tuple[int, int], right: tuple[int, int], m: Model, first: bool) -> list[int] | None:
    """Ids after the left piece up to and with the right one; None if no result runs through both."""
    if left == right and left[0] != left[1]:
        return []
    if left[1] > right[0]:
        return None
    middle, mark, end = text[left[1] : right[0]], text[left[0] : left[1]], text[right[0] : right[1]]
    if first:  # the library puts a blank in front of a text
        middle = " " + middle
    ids = m.inner(middle)
    if not middle:
        ok = m.agree(mark, end)
    else:
        a, b = m.split(ids, middle)
        ok = m.agree(mark, a) and m.agree(b, end)
    return [*ids, *m.inner(end)] if ok else None


def transfer(text: str, low: int, high: int, m: Model, first: bool) -> np.ndarray:
    """The max-plus matrix of a chunk. ``text`` reaches past the cuts ``low`` and ``high`` by a piece's length."""
    left, right = states(text, low, m), states(text, high, m)
    if len(left) == len(right) == 1 and not m.unigram:
        return np.zeros((1, 1))
    out = np.full((len(left), len(right)), -math.inf)
    inner = [p for p in _lone_spaces(text, low + m.longest, high - m.longest) if len(left) > 1 or len(right) > 1] if m.spaces_lead else []
    if inner:
        a = np.array([_value(between(text, s, (inner[0], inner[0]), m, first), m) for s in left])
        b = np.array([_value(between(text, (inner[-1], inner[-1]), s, m, False), m) for s in right])
        core = _value(m.inner(text[inner[0] : inner[-1]]), m) if m.unigram else 0.0
        return a[:, None] + core + b[None, :]
    for i, s in enumerate(left):
        for j, e in enumerate(right):
            out[i, j] = _value(between(text, s, e, m, first), m)
    return out


def _lone_spaces(text: str, low: int, high: int) -> list[int]:
    first = next((i for i in range(max(1, low), high) if is_safe(text, i)), None)
    if first is None:
        return []
    return [first, next(i for i in range(high - 1, first - 1, -1) if is_safe(text, i))]


def _value(ids: list[int] | None, m: Model) -> float:
    return -math.inf if ids is None else m.score(ids)


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def best_states(matrices: list[np.ndarray], first: int = 0, last: int = 0) -> list[int]:
    """The state at every cut on the best path from ``first`` to ``last``: prefix products forward, then one choice per cut backward."""
    start = np.full((1, len(matrices[0])), -math.inf)
    start[0, first] = 0
    reach = [start]
    for t in matrices:
        reach.append(max_plus(reach[-1], t))
    chosen = [last]
    for k in range(len(matrices) - 1, -1, -1):
        chosen.append(int(np.argmax(reach[k][0] + matrices[k][:, chosen[-1]])))
    return chosen[::-1]


#: Matrices that one step of the tree combines.
FAN = 64
PIECE = "doc_id long, no_id boolean, key string, chunk int, chunks int, text string, low int, high int"
IDS = "chunk int, chunks int, ids array<int>"
DIGEST = "chunk int, chunks int, n_ids long, ids_crc32 long, n_chars long, text_md5 string"
HEAD = "doc_id long, no_id boolean, key string, "


def chunks(source: DataFrame, path: str, chunk: int, search: int) -> DataFrame:
    """Rows of chunks out of ``source(doc_id, no_id, key, text)``."""

    def run(batches):
        m = model(path)
        for frame in batches:
            rows = []
            for doc, none, key, text in zip(frame["doc_id"], frame["no_id"], frame["key"], frame["text"], strict=True):
                at = cuts(text, m, chunk, search)
                for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    begin = max(0, a - m.longest - 1)
                    rows.append((doc, none, key, i, len(at) - 1, text[begin : b + m.longest + 2], a - begin, b - begin))
            yield pd.DataFrame(rows, columns=["doc_id", "no_id", "key", "chunk", "chunks", "text", "low", "high"])

    return source.mapInPandas(run, PIECE)


MATRIX = "key string, at int, height int, matrix binary"


def _groups(batches):
    """Runs of rows of one (key, above), over the ends of batches."""
    held, now = [], None
    for frame in batches:
        for r in frame.itertuples(index=False):
            if (r.key, r.above) != now:
                if held:
                    yield now, held
                held, now = [], (r.key, r.above)
            if not held or held[-1].at != r.at:
                held.append(r)
    if held:
        yield now, held


def _matrices(rows: list) -> list[np.ndarray]:
    return [np.frombuffer(r.matrix).reshape(r.height, -1) for r in rows]


def _written(rows: list, columns: list[str], batch: int = 5000):
    for a in range(0, len(rows), batch):
        yield pd.DataFrame(rows[a : a + batch], columns=columns)


def _products(batches):
    """One matrix for each run of neighbours."""
    out = []
    for (key, above), rows in _groups(batches):
        whole = functools.reduce(max_plus, _matrices(rows))
        out.append((key, above, len(whole), whole.tobytes()))
    yield from _written(out, ["key", "at", "height", "matrix"])


def _descend(batches):
    """The states between neighbours, given those at the ends of their run."""
    out = []
    for (key, _), rows in _groups(batches):
        chosen = best_states(_matrices(rows), rows[0].from_state, rows[0].to_state)
        out += [(key, r.at, a, b) for r, a, b in zip(rows, chosen[:-1], chosen[1:], strict=True)]
    yield from _written(out, ["key", "at", "from_state", "to_state"])


def _together(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key", "above").sortWithinPartitions("key", "above", "at")


def chosen_states(matrices: DataFrame, longest: int, fan: int = FAN) -> DataFrame:
    """``matrices(key, at, height, matrix)`` -> ``(key, at, from_state, to_state)`` on each key's best path. Products of ``fan``
    neighbours, then of ``fan`` of these, and so on up to one run a key; then down again, each run by itself. ``longest``:
    the most matrices of a key. Repeated rows count once, and before they are sent, so that a key's rows are as many as its places."""
    above = F.floor(F.col("at") / fan).cast("int")
    once = matrices.groupBy("key", "at").agg(F.first("height").alias("height"), F.first("matrix").alias("matrix"))
    levels = [once.withColumn("above", above)]
    while longest > fan:
        longest = math.ceil(longest / fan)
        up = staged(_together(levels[-1]).mapInPandas(_products, MATRIX), "products")
        levels.append(up.withColumn("above", above))
    schema = "key string, at int, from_state int, to_state int"
    ends = levels.pop().withColumn("from_state", F.lit(0)).withColumn("to_state", F.lit(0))
    while True:
        states_ = _together(ends).mapInPandas(_descend, schema)
        if not levels:
            return states_
        ends = levels.pop().join(states_.withColumnRenamed("at", "above"), ["key", "above"])


def _ids(m: Model, frame: pd.DataFrame, ids: list) -> pd.DataFrame:
    return frame.assign(ids=ids)


def _digest(m: Model, frame: pd.DataFrame, ids: list) -> pd.DataFrame:
    """Counts and hashes of the ids and of the text that they decode to."""
    text = m.sp.decode(ids) if len(ids) and (frame["chunk"] == 0).all() else [m.joined(i, c == 0) for i, c in zip(ids, frame["chunk"], strict=True)]
    crc = [zlib.crc32(np.asarray(i, "<u4").tobytes()) for i in ids]
    return frame.assign(n_ids=list(map(len, ids)), ids_crc32=crc, n_chars=list(map(len, text)), text_md5=[hashlib.md5(t.encode()).hexdigest() for t in text])


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, search: int = SEARCH) -> DataFrame:
    """``(doc_id, key, chunk, chunks, ids)``: a document's ids are those of its chunks in turn, equal to what the library gives
    the whole text. Null and empty texts have one chunk without ids. ``key`` is the row's ``row_key``; a row that repeats another in id
    and text gives its chunks again. A model whose normalisation changes texts is applied to whole texts."""
    return _encoded(docs, path, id_col, text_col, chunk, search, _ids, IDS)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, search: int = SEARCH) -> DataFrame:
    """``(doc_id, key, chunk, chunks, n_ids, ids_crc32, n_chars, text_md5)``: encode and decode within one task; the ids are counted
    and hashed there, and so is the text they give back."""
    return _encoded(docs, path, id_col, text_col, chunk, search, _digest, DIGEST)


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str, chunk: int, search: int, emit, schema: str) -> DataFrame:
    prepare(docs.sparkSession)
    number = F.col(id_col).cast("long")
    source = docs.select(F.coalesce(number, F.lit(0).cast("long")).alias("doc_id"), number.isNull().alias("no_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    length = F.coalesce(F.length("text"), F.lit(0))
    names = ["doc_id", "no_id", "key", "chunk", "chunks"]

    def plain(batches):
        m = model(path)
        for frame in text_batches(batches):
            ids = m.sp.encode([t if isinstance(t, str) else "" for t in frame["text"]], num_threads=1) if len(frame) else []
            yield emit(m, frame.assign(chunk=0, chunks=1)[names], ids)

    def matrices(batches):
        m = model(path)
        for frame in batches:
            found = [transfer(t, a, b, m, c == 0) for t, a, b, c in zip(frame["text"], frame["low"], frame["high"], frame["chunk"], strict=True)]
            yield pd.DataFrame({"key": frame["key"], "at": frame["chunk"], "height": [len(t) for t in found], "matrix": [t.tobytes() for t in found]})

    def trace(batches):
        m = model(path)
        for frame in batches:
            ids = []
            for t, a, b, c, i, j in zip(frame["text"], frame["low"], frame["high"], frame["chunk"], frame["from_state"], frame["to_state"], strict=True):
                ids.append(between(t, states(t, a, m)[i], states(t, b, m)[j], m, c == 0) if m.cuttable else m.sp.encode(t))
            yield emit(m, frame[names], ids)

    short = source.filter(length <= chunk + search).mapInPandas(plain, HEAD + schema)
    longest = docs.agg(F.max(F.length(text_col))).first()[0] or 0
    if longest <= chunk + search:
        return with_null_ids(short)
    # The text of a cut reaches ``search`` back at most, so chunks are no shorter than this.
    most = math.ceil(longest / max(1, chunk - search))
    large = chunks(source.filter(length > chunk + search), path, chunk, search)
    chosen = chosen_states(large.mapInPandas(matrices, MATRIX), most)
    traced = large.join(chosen.withColumnRenamed("at", "chunk"), ["key", "chunk"]).mapInPandas(trace, HEAD + schema)
    return with_null_ids(short.unionByName(traced))


def decode_chunks(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``text``, the text of each chunk; a document's text is that of its chunks in turn."""

    def run(batches):
        m = model(path)
        for frame in batches:
            yield frame.assign(text=[m.joined([int(x) for x in ids], c == 0) for ids, c in zip(frame["ids"], frame["chunk"], strict=True)])

    number = encoded.withColumn("no_id", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0).cast("long")))
    return with_null_ids(number.select("doc_id", "no_id", "key", "chunk", "chunks", "ids").mapInPandas(run, HEAD + IDS + ", text string"))
