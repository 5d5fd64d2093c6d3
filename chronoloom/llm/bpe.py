"""Byte-level BPE encoding and decoding of whole documents, long ones in parallel.

``encode`` gives each text's ids as the tokenizers library does for the same file with
add_special_tokens=False.  A text longer than LEAF characters is cut into halves, these into halves,
and so on; the leaves are encoded as rows of their own, dealt over the cluster, and then joined
pairwise up the tree.  At a join, a window around it is encoded anew and grows until it agrees
exactly with what stands on both sides:

* its edges are places where every pre-token ends whatever stands around them: between two
  characters of different classes (letter, number, space, other), the first of which is neither a
  space nor an apostrophe, and not inside an added token's text; what lies outside such edges is
  encoded alike in the part and in the whole; or
* where a stretch of one class leaves no such place, both edges are token boundaries, and the
  window's first and last tokens are those already there.  A sequence of tokens is the BPE encoding
  of a pre-token exactly if each two neighbours are that of their own text, so agreement of one token
  on either side carries over.

A window that agrees nowhere grows to both whole parts, which is the encoding itself.

Leaves and windows are encoded by tiktoken where the file is byte-level BPE whose ids follow merge
order (it then gives the same ids several times faster), else by the tokenizers library.

Defined results: a null or empty text has no ids and decodes to the empty text; rows that repeat
each have a result; ids are bytes, four for each, little-endian; other columns are ignored; no rows
give no rows.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_by_key

#: Characters of the longest text that is encoded in one go.
LEAF = 1 << 14
#: Characters on either side of a join in its first window.
WINDOW = 32
#: Texts encoded or decoded at once.
ROWS = 512

# Fixed value: the pre-tokenisation pattern of byte-level BPE as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Code points with the White_Space property.
_SPACES = frozenset([*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=1 << 16)
def kind(c: str) -> str:
    """L, N, S (space), P (other), or nothing for what Unicode versions may differ on."""
    if ord(c) in _SPACES:
        return "S"
    if "\x1c" <= c <= "\x1f":
        return ""
    major = unicodedata.category(c)
    return "" if major == "Cn" else major[0] if major[0] in "LN" else "P"


class Codec:
    """One tokenizer file, ready to encode and decode."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        vocab = {token: i for token, i in spec["model"]["vocab"].items() if token not in self.added}
        if not all(c in alphabet for token in vocab for c in token):
            raise ValueError("not a byte-level vocabulary")
        spelled = {i: bytes(alphabet[c] for c in token) for token, i in vocab.items()} | {i: token.encode() for token, i in self.added.items()}
        self.size = max(spelled) + 1
        self.lengths = np.array([len(spelled.get(i, b"")) for i in range(self.size)], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.pool = np.frombuffer(b"".join(spelled.get(i, b"") for i in range(self.size)), np.uint8)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        made = [vocab.get(a + b, -1) for a, b in merges]
        before = spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        free = not any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in spec["added_tokens"])
        if plain and free and made == sorted(made) and (not made or made[0] > max(i for t, i in vocab.items() if len(t) == 1)):
            import tiktoken

            ranks = {text: i for i, text in spelled.items() if i not in self.added.values()}
            fast = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.added)
            self.encode = lambda text: fast.encode_to_numpy(text, allowed_special="all")
        else:
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(path)
            slow.no_truncation()
            slow.no_padding()
            self.encode = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str] | pa.Array:
        """Texts of rows of ids; ends has len+1 offsets into ids.  Bytes that are no UTF-8 become U+FFFD."""
        if len(ids) == 0:
            return pa.array([""] * (len(ends) - 1), pa.large_string())
        lengths = self.lengths[ids]
        stop = np.cumsum(lengths)
        source = np.repeat(self.starts[ids] - (stop - lengths), lengths) + np.arange(stop[-1])
        data = self.pool[source]
        offsets = np.concatenate([[0], stop])[ends]
        whole = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
        try:
            return whole.cast(pa.large_string())
        except pa.ArrowInvalid:
            return pa.array([x.as_py().decode("utf-8", "replace") for x in whole], pa.large_string())


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def halves(n: int, leaf: int) -> list[int]:
    """Cuts of n characters into 2^d parts of at most leaf characters."""
    parts = 1
    while n > parts * leaf:
        parts *= 2
    return [n * k // parts for k in range(parts + 1)]


def _certain(text: str, p: int, added: dict[str, int]) -> bool:
    """Whether every pre-tokenisation of a text that holds this one has a boundary at p."""
    x, y = text[p - 1], text[p]
    a, b = kind(x), kind(y)
    if not a or not b or a == b or a == "S" or x == "'":
        return False
    return not any(token in text[max(0, p - len(token) + 1) : p + len(token) - 1] for token in added)


def _uniform(text: str, added: dict[str, int]) -> bool:
    return len({kind(c) for c in text}) == 1 and kind(text[0]) != "" and not any(token in text for token in added)


def join(c: Codec, left: tuple[str, np.ndarray], right: tuple[str, np.ndarray]) -> tuple[str, np.ndarray]:
    """The text and ids of two neighbouring parts, given those of each."""
    (a, ia), (b, ib) = left, right
    if not a or not b:
        return a + b, np.concatenate([ia, ib])
    ends_a, ends_b = np.cumsum(c.lengths[ia]), np.cumsum(c.lengths[ib])
    reach = max((len(t) for t in c.added), default=1) + 2
    window = WINDOW
    while True:
        whole = a[-4 * window :] + b[: 4 * window]
        cut = min(len(a), 4 * window)
        s = next((p for p in range(cut - window, max(0, cut - 2 * window), -1) if p > 0 and _certain(whole, p, c.added)), None)
        e = next((p for p in range(cut + window, min(len(whole), cut + 2 * window)) if _certain(whole, p, c.added)), None)
        at_start, at_end = window >= len(a), window >= len(b)
        s, e = 0 if at_start else s, len(whole) if at_end else e
        if s is not None and e is not None:
            ka = len(ia) if s == cut else int(np.searchsorted(ends_a, ends_a[-1] - len(whole[s:cut].encode()), "right"))
            ka = 0 if at_start else ka
            kb = len(ib) if at_end else int(np.searchsorted(ends_b, len(whole[cut:e].encode()), "right"))
            middle = c.encode(whole[s:e])
            return a + b, np.concatenate([ia[:ka], middle, ib[kb:]])
        if found := _within(c, a, b, ia, ib, ends_a, ends_b, window, reach):
            return a + b, found[0]
        window *= 2


def _within(c: Codec, a: str, b: str, ia: np.ndarray, ib: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, window: int, reach: int) -> list[np.ndarray]:
    """The joined ids, in a list, if the window lies within one pre-token and its outermost tokens are those already there."""
    if window + reach >= len(a) or window + reach >= len(b) or not _uniform(a[-window - reach :] + b[: window + reach], c.added):
        return []
    raw_a, raw_b = a[-window:].encode(), b[:window].encode()
    ka = int(np.searchsorted(ends_a, ends_a[-1] - len(raw_a), "left")) + 1
    kb = int(np.searchsorted(ends_b, len(raw_b), "right"))
    if ka >= len(ia) or kb < 1:
        return []
    head = raw_a[len(raw_a) - int(ends_a[-1] - ends_a[ka - 1]) :]
    tail = raw_b[: int(ends_b[kb - 1])]
    try:
        middle = c.encode((head + tail).decode("utf-8"))
    except UnicodeDecodeError:  # a token boundary inside a character
        return []
    if len(middle) and middle[0] == ia[ka] and middle[-1] == ib[kb - 1]:
        return [np.concatenate([ia[:ka], middle, ib[kb:]])]
    return []


def join_all(c: Codec, parts: list[tuple[str, np.ndarray]]) -> np.ndarray:
    """Joins a power of two of neighbouring parts pairwise, level by level."""
    while len(parts) > 1:
        parts = [join(c, parts[i], parts[i + 1]) for i in range(0, len(parts), 2)]
    return parts[0][1]


def _packed(ids: list[np.ndarray]) -> pa.Array:
    return pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())


def _decoded(c: Codec, packed: pa.Array) -> pa.Array:
    """The texts of rows of packed ids."""
    rows = [x or b"" for x in packed.to_pylist()]
    texts = [pa.array([], pa.large_string())]
    for k in range(0, len(rows), ROWS):
        some = rows[k : k + ROWS]
        ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in some])]).astype(np.int64)
        texts.append(c.decode_all(np.frombuffer(b"".join(some), "<u4"), ends))
    return pa.concat_arrays(texts).cast(pa.string())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, decoded: bool = False) -> DataFrame:
    """(id_col, ids) for each row of docs, and with decoded the text that the ids decode to; path names the tokenizer file on every executor."""
    names = [id_col, "ids"] + ["decoded"] * decoded

    def out(c: Codec, keys: pa.Array, ids: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, ids] + ([_decoded(c, ids)] if decoded else []), names=names)

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                yield out(c, batch.column(0), _packed([c.encode(t or "") for t in batch.column(1).to_pylist()]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                ends = halves(len(text), leaf)
                n = len(ends) - 1
                keys = [pa.concat_arrays([batch.column(k).slice(i, 1)] * n) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(range(n), pa.int32()), pa.array([text[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)])], names=[id_col, "digest", "part", "piece"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids = _packed([c.encode(t) for t in batch.column(3).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[id_col, "digest", "part", "piece", "ids"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for _, rows in rows_by_key(batches, 2):
            numbers = rows.column(2).to_pylist()
            first = {n: i for i, n in reversed(list(enumerate(numbers)))}
            parts = [(rows.column(3)[first[n]].as_py(), np.frombuffer(rows.column(4)[first[n]].as_py(), "<u4")) for n in sorted(first)]
            copies = numbers.count(0)
            key = rows.column(0).combine_chunks().slice(0, 1)
            yield out(c, pa.concat_arrays([key] * copies), pa.concat_arrays([_packed([join_all(c, parts)])] * copies))

    kinds = dict(docs.dtypes)
    given = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    long = F.coalesce(F.length("text"), F.lit(0)) > leaf
    ident = f"`{id_col}` {kinds[id_col]}"
    result = f"{ident}, ids binary" + ", decoded string" * decoded
    short = given.where(~long).mapInArrow(direct, result)
    pieces = given.where(long).select(id_col, F.sha2("text", 256).alias("digest"), "text").mapInArrow(cut, f"{ident}, digest string, part int, piece string")
    encoded = pieces.repartition(id_col, "digest", "part").mapInArrow(leaves, f"{ident}, digest string, part int, piece string, ids binary")
    gathered = encoded.repartition(id_col, "digest").sortWithinPartitions(id_col, "digest", "part")
    return short.unionByName(gathered.mapInArrow(joined, result))


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """encoded with a column decoded: the texts of its column ids."""
    kinds = dict(encoded.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _decoded(c, batch.column(1))], names=[id_col, "ids", "decoded"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kinds[id_col]}, ids binary, decoded string")
