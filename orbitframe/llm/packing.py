"""First-fit decreasing packing of token pieces, with a tournament tree over bin capacities."""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, prepare, staged, text_batches, with_null_ids

_ENCODERS: dict = {}


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; any other path may be given in its place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str):
    """One tokenizer per worker process."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _ENCODERS[path] = Tokenizer.from_file(path)
    return _ENCODERS[path]


def _bytes_of_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write bytes with."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Ids:
    """Ids of whole texts as ``tokenizers`` gives them for a file, its special strings included.

    Where the file's merges come in the order of their ids, as ranks, a rank encoder gives the same ids in less than half
    of the time. ``proven`` holds the two against each other on every word of the vocabulary and on every character of the
    basic plane beside letters, digits, marks and blanks: words are cut by character class, and within a word only the vocabulary
    counts. Texts with a special string, a character beyond that plane or 300 blanks in a row, on which the rank
    encoder's pattern is slow, go to the tokenizer itself. So does everything where the proof fails."""

    LONG_BLANK = re.compile(r"(?:^|\S)\s{300}")
    #: 300 characters in a row hold three of every hundredth one, which is looked at first.
    SOME_BLANK = re.compile(r"\s{3}")

    def __init__(self, path: str, by_ranks: bool = True):
        self.tokenizer, self.ranks = encoder(path), None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if not by_ranks:
            return
        letters = _bytes_of_letters()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary = {w: i for w, i in model.get("vocab", {}).items() if all(c in letters for c in w)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
        order = [vocabulary.get("".join(m), -1) for m in merges]
        if order and min(order) >= 256 and order == sorted(order):
            import tiktoken

            by_bytes = {bytes(letters[c] for c in w): i for w, i in vocabulary.items()}
            try:
                self.ranks = tiktoken.Encoding("ranks", pat_str=PRE_TOKEN, mergeable_ranks=by_bytes, special_tokens={})
            except (ValueError, KeyError):
                return

    def slow(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def ranked(self, text: str) -> bool:
        """Whether the rank encoder may take the text."""
        if self.ranks is None or any(s in text for s in self.special):
            return False
        if not text.isascii() and len(text.encode("utf-16-le", "surrogatepass")) != 2 * len(text):
            return False
        return not (self.SOME_BLANK.search(text[99::100]) and self.LONG_BLANK.search(text))

    def encode(self, text: str) -> np.ndarray:
        return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False) if self.ranked(text) else self.slow(text)

    def agrees(self) -> bool:
        if self.ranks is None:
            return False
        plane = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
        texts = ["".join(f"a{c}1{c}!{c}{c} {c} \n{c}" for c in plane[i : i + 64]) for i in range(0, len(plane), 64)]
        letters = _bytes_of_letters()
        for word in self.tokenizer.get_vocab():
            if all(c in letters for c in word):
                texts.append(bytes(letters[c] for c in word).decode("utf-8", "ignore"))
        texts = [t for t in texts if self.ranked(t)]
        parts = (texts[i : i + 2000] for i in range(0, len(texts), 2000))
        return all(self.ranks.encode_ordinary(t) == e.ids for p in parts for t, e in zip(p, self.tokenizer.encode_batch(p, add_special_tokens=False), strict=True))


@functools.cache
def worker_ids(path: str, by_ranks: bool) -> Ids:
    """One for each file per worker process, through all its tasks."""
    return Ids(path, by_ranks)


_PROVEN: dict[str, bool] = {}


def proven(spark: SparkSession, path: str) -> bool:
    """Whether the rank encoder of a file gives the tokenizer's ids; found out once, by a task."""
    if path not in _PROVEN:
        task = spark.range(0, 1, 1, 1).mapInPandas(lambda rows: (pd.DataFrame({"ok": [Ids(path).agrees()] * len(r)}) for r in rows), "ok boolean")
        _PROVEN[path] = task.first()[0]
    return _PROVEN[path]


#: Fixed value: how the byte-level vocabulary's pre-tokenizer cuts a text.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, ids)``: each document's ids and ``end_id``, cut every ``length``. Without
    ``with_ids`` the ids stay in their task."""
    names = ["doc_id", "no_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    by_ranks = proven(docs.sparkSession, tokenizer)

    def run(batches):
        cache = worker_ids(tokenizer, by_ranks)
        for frame in text_batches(batches, 4_000_000):
            rows = []
            for doc, none, text in zip(frame["doc_id"], frame["no_id"], frame["text"], strict=True):
                ids = cache.encode(text) if isinstance(text, str) else np.zeros(0, "<u4")
                ids = np.append(ids, np.array([end_id], "<u4"))
                for a in range(0, len(ids), length):
                    part = ids[a : a + length]
                    rows.append((doc, none, a, len(part), zlib.crc32(part), len(ids), *[part.astype("<i4")] * with_ids))
            yield pd.DataFrame(rows, columns=names)

    return map_texts(docs, run, ", ".join(f"{n} {'array<int>' if n == 'ids' else 'long'}" for n in names[2:]), id_col, text_col)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item and its offset there. The tree's leaves are the bins' free places; every inner node has the
    larger of its two children, so the leftmost bin with room is found by one descent."""
    n = len(sizes)
    width = 1 << max(0, int(n - 1).bit_length())
    tree = [capacity] * (2 * width)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, at = int(sizes[i]), 1
        while at < width:
            at *= 2
            if tree[at] < size:
                at += 1
        bins[i], offsets[i] = at - width, capacity - tree[at]
        tree[at] -= size
        while at > 1:
            at //= 2
            left, right = tree[2 * at], tree[2 * at + 1]
            top = left if left > right else right
            if tree[at] == top:
                break
            tree[at] = top
    return bins, offsets


def pack(pieces: DataFrame, length: int = 2048, group_rows: int = 8192, seed: int = 42) -> DataFrame:
    """``pieces(doc_id, start, length, ...)`` -> the same rows with ``sequence_id`` and ``offset``.

    Pieces go to randomised groups of about ``group_rows`` by a hash of their place in the table, which must be a written one
    that every read gives alike, so that rows of one id spread as others do; each group is packed by
    itself. A piece of full length fills a sequence alone. Sequence ids are the group's number and the bin's within it.
    Repeated rows are packed as often as they occur."""
    total = pieces.count()
    groups = max(1, round(total / group_rows))
    names = pieces.columns

    def run(key, frame):
        frame = frame.sort_values(["no_id", "doc_id", "start", "ids_crc32"] if "ids_crc32" in frame else ["no_id", "doc_id", "start"], kind="stable")
        bins, offsets = first_fit_decreasing(frame["length"].to_numpy(np.int64), length)
        return frame[["no_id", *names]].assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    dealt = pieces.withColumn("no_id", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0).cast("long")))
    dealt = dealt.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return with_null_ids(dealt.groupBy("grp").applyInPandas(run, "no_id boolean, " + schema)).select(*names, "sequence_id", "offset")


def packed_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack: ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``, one row per piece.

    A null text is empty: one piece with the end id alone. Ids travel to the groups only with ``with_ids``; a sequence is
    its pieces' ids by offset, padded to ``length``."""
    prepare(docs.sparkSession)
    pieces = staged(token_pieces(docs, tokenizer, id_col, text_col, length, with_ids=with_ids), "pieces")
    return pack(pieces, length)
