"""Encoding a corpus with a public byte-level BPE tokenizer, each recurring chunk once.

Texts are cut where a rolling hash of the last WINDOW code points has some bits unset, so equal passages
are cut alike wherever they lie. Distinct chunks are encoded once; a document is the join of its chunks'
ids. Where there are blanks, cuts are made before one that follows something else, as blanks always start a new split there: such
a join holds as it is. Elsewhere a cut may fall inside what the tokenizer would have kept together, so the join is repaired: from a
place in the left chunk that the cut can't have changed, text is split and encoded again until a split
point coincides with one of the right chunk's own. From there on both splits are the same, because
a split depends only on the place where it starts: agreement is exact, not likely. Only chunks at such cuts travel with their text.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: the published pattern that splits text before the merges of the byte_bpe rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A place this many code points before a chunk's end can't be changed by what follows: contractions look
#: at three, the blank rule at one.
LOOKAHEAD = 3
#: The code points with the White_Space property, which is what the pattern's blanks are.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: Code points of the hash and of the least chunk; bits that are unset at a cut before a blank and elsewhere, where the last NO_BLANK code points have none.
WINDOW, LEAST = 16, 96
AT_BLANK, ELSEWHERE, NO_BLANK = np.uint64(0x3F), np.uint64(0x1FF), 64
#: Code points that are hashed side by side.
BLOCK = 1 << 18


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def splitter():
    import regex

    return regex.compile(PATTERN.replace(r"[^\s", f"[^{BLANKS}").replace(r"\S", f"[^{BLANKS}]").replace(r"\s", f"[{BLANKS}]"))


def rank_file(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZER_DIR, f"{name}.tiktoken")


@lru_cache(maxsize=1)
def _blank_table() -> np.ndarray:
    t = np.zeros(0x3002, bool)
    t[[ord(c) for c in BLANKS]] = True
    return t


def _places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where text may be cut, and whether each place is inside what the tokenizer may keep together."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = _blank_table()[np.minimum(codes, 0x3001)]
    with np.errstate(over="ignore"):
        h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        # sum of h[i-k] * B^k over the window, by doubling
        width, power = 1, np.uint64(0xBF58476D1CE4E5B9)
        while width < WINDOW:
            h[width:] = h[width:] + h[:-width] * power
            width, power = width * 2, power * power
        h ^= h >> np.uint64(31)
    at = np.flatnonzero((h[:-1] & AT_BLANK) == 0)  # a cut is after the code point at
    joined = blank[at] | ~blank[at + 1]
    seen = np.concatenate([[0], np.cumsum(blank)])
    plain = ((h[at] & ELSEWHERE) == 0) & (seen[at + 1] == seen[np.maximum(at + 1 - NO_BLANK, 0)])
    use = ~joined | plain
    return at[use] + 1, joined[use]


def _cuts(places: list[int], joined: list[bool], begin: int, end: int) -> list[tuple[int, bool]]:
    """The ends of the chunks of the text in [begin, end), and whether each is a cut inside what may belong together."""
    out, last = [], begin
    for p, j in zip(places, joined):
        if p - last >= LEAST and end - p >= LEAST // 2:
            out.append((p, j))
            last = p
    return [*out, (end, False)]


def cut_points(text: str) -> list[int]:
    """Ends of the content-defined chunks of text; the last is its length."""
    if len(text) <= LEAST:
        return [len(text)]
    places, joined = _places(text)
    return [e for e, _ in _cuts(places.tolist(), joined.tolist(), 0, len(text))]


def _blocks(rows):
    block, total = [], 0
    for r in rows:
        block.append(r)
        total += len(r[2])
        if total >= BLOCK:
            yield block
            block, total = [], 0
    if block:
        yield block


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per chunk: its document, the hash of the whole text, its number, key and text, and whether its left cut and any of its cuts are to be repaired."""
    for b in batches:
        ids, rows, at, keys, texts, left, either = [], [], [], [], [], [], []
        source = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), ((t or "") for t in b.column(2).to_pylist()))
        for block in _blocks(source):
            whole = "".join(t for _, _, t in block)
            places, joined = _places(whole) if len(whole) > LEAST else (np.empty(0, np.int64), np.empty(0, bool))
            ends = np.cumsum([len(t) for _, _, t in block])
            lo = np.searchsorted(places, ends - [len(t) for _, _, t in block]).tolist()
            hi = np.searchsorted(places, ends).tolist()
            places, joined, begin = places.tolist(), joined.tolist(), 0
            for (i, row, _), end, x, y in zip(block, ends.tolist(), lo, hi):
                start, before = begin, False
                for k, (e, j) in enumerate(_cuts(places[x:y], joined[x:y], begin, end)):
                    c = whole[start:e]
                    ids.append(i)
                    rows.append(row)
                    at.append(k)
                    keys.append(hashlib.blake2b(c.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                    texts.append(c)
                    left.append(before)
                    either.append(before or j)
                    start, before = e, j
                begin = end
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(at, pa.int32()), pa.array(keys, pa.binary()), pa.array(texts, pa.string()), pa.array(left, pa.bool_()), pa.array(either, pa.bool_())],
            names=["_doc", "_row", "_at", "_key", "_chunk", "_left", "_either"],
        )


def split_ends(text: str, start: int = 0) -> Iterator[int]:
    for m in splitter().finditer(text, start):
        yield m.end()


def safe_start(text: str) -> int:
    """A split point of text, and of any longer text that begins with it, near the end: where blanks follow something
    else, as blanks always start a new split. 0 if there is none."""
    for p in range(len(text) - LOOKAHEAD - 1, 0, -1):
        if text[p] in BLANKS and text[p - 1] not in BLANKS:
            return p
    return 0


class Joiner:
    """Joins chunk encodings of one tokenizer exactly."""

    def __init__(self, path: str):
        self.enc = encoder(path)
        self.bytes = self.enc.decode_single_token_bytes
        self.repaired = 0

    def ids(self, text: str) -> list[int]:
        return self.enc.encode_ordinary(text)

    def before(self, ids: Sequence[int], tail: str) -> Sequence[int] | None:
        """ids without those of the text's tail; None if no token begins there."""
        k, left = len(ids), len(tail.encode())
        while left > 0:
            k -= 1
            left -= len(self.bytes(int(ids[k])))
        return ids[:k] if left == 0 else None

    def after(self, ids: Sequence[int], head: str) -> Sequence[int] | None:
        k, left = 0, len(head.encode())
        while left > 0:
            left -= len(self.bytes(int(ids[k])))
            k += 1
        return ids[k:] if left == 0 else None

    def join(self, chunks: list[str], ids: list[list[int]]) -> list[int]:
        """ids of the concatenated chunks."""
        chunks, ids = [c for c in chunks if c], [x for c, x in zip(chunks, ids) if c]
        if not chunks:
            return []
        left = [bool(a and b and (a[-1] in BLANKS or b[0] not in BLANKS)) for a, b in zip(["", *chunks], chunks)]
        return [x for part in self.parts(chunks, ids, left) for x in part]

    def parts(self, chunks: Sequence[str | None], ids: Sequence[Sequence[int]], left: Sequence[bool]) -> list[Sequence[int]]:
        """Lists that make up the ids of the concatenated chunks. left: the chunk's join to those before is to be repaired, for which both need their
        text. text, own: the open end; it starts at a split point of the whole text."""
        done: list[Sequence[int]] = []
        text, own = chunks[0], ids[0]
        for right, right_ids, broken in zip(chunks[1:], ids[1:], left[1:]):
            if broken:
                text, own = self.repair(done, text, own, right, right_ids)
            else:
                done.append(own)
                text, own = right, right_ids
        done.append(own)
        return done

    def repair(self, done: list[Sequence[int]], text: str, own: Sequence[int], right: str, right_ids: Sequence[int]) -> tuple[str, Sequence[int]]:
        """Extends done up to where both splits agree; returns the rest of right, or all that is open if they never do."""
        self.repaired += 1
        safe = safe_start(text)
        for e in split_ends(text, safe):
            if e + LOOKAHEAD > len(text):
                break
            safe = e
        head, open_text, border = self.before(own, text[safe:]), text[safe:] + right, len(text) - safe
        if head is not None:
            mine, theirs = split_ends(open_text), split_ends(right)
            a, b = next(mine, None), next(theirs, None)
            while a is not None and b is not None and a != b + border:
                if a < b + border:
                    a = next(mine, None)
                else:
                    b = next(theirs, None)
            # agreement within reach of the next chunk is not certain yet
            certain = a is not None and b is not None and a + LOOKAHEAD <= len(open_text)
            rest = self.after(right_ids, right[:b]) if certain else None
            if rest is not None:
                done.append(head)
                start = 0
                for e in split_ends(open_text):  # piece by piece: a cut at the last one would split its blanks otherwise
                    done.append(self.ids(open_text[start:e]))
                    start = e
                    if e == a:
                        break
                return right[b:], rest
            done.append(head)
            return open_text, self.ids(open_text)
        return text + right, self.ids(text + right)


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids of every text, without special tokens.

    Cases: null and empty texts have an empty list; a string that looks like a special token is ordinary
    text; a text of any length is cut into chunks, so only its own row must fit a task; equal texts are
    encoded once by their chunks; each input row gives one output row, but rows equal in doc_id and text give one together (null and empty
    texts are equal here); a null doc_id is an id like others; extra columns are ignored; an empty table gives an empty table.
    """
    path = rank_file(name, folder)
    src = docs.select(F.col(doc_id).cast("long").alias("_doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_row"), F.col(text).alias("_text"))
    pieces = src.mapInArrow(_chunks, "_doc long, _row long, _at int, _key binary, _chunk string, _left boolean, _either boolean")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            got = [enc.encode_to_numpy(t, disallowed_special=()).astype(np.int32) for t in b.column("_chunk").to_pylist()]
            ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got) if got else np.empty(0, np.int32)))
            text_ = pc.if_else(b.column("_either"), b.column("_chunk"), pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("_key"), text_, ids], names=["_key", "_chunk", "_ids"])

    # many documents to a chunk: the ids travel once per document piece, the chunk is encoded once
    coded = pieces.groupBy("_key").agg(F.first("_chunk").alias("_chunk"), F.max("_either").alias("_either")).mapInArrow(encode, "_key binary, _chunk string, _ids array<int>")
    placed = pieces.select("_doc", "_row", "_at", "_key", "_left").join(coded, "_key")
    whole = placed.groupBy("_doc", "_row").agg(F.array_sort(F.collect_list(F.struct("_at", "_left", "_chunk", "_ids"))).alias("_all"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j = Joiner(path)
        for b in batches:
            every = b.column("_all")
            rows, chunk = every.offsets.to_numpy().tolist(), every.values
            at, left = chunk.field("_at").to_numpy(), chunk.field("_left").to_numpy(zero_copy_only=False)
            of, ids = chunk.field("_ids").offsets.to_numpy().tolist(), chunk.field("_ids").values.to_numpy()
            text_ = chunk.field("_chunk")
            parts: list[Sequence[int]] = []
            ends = [0]
            for x, y in zip(rows[:-1], rows[1:]):
                # rows delivered twice have each chunk twice
                own = range(x, y) if y - x < 2 or at[y - 1] == y - x - 1 else [k for k in range(x, y) if k == x or at[k] != at[k - 1]]
                mine = [ids[of[k] : of[k + 1]] for k in own]
                broken = [bool(left[k]) for k in own]
                got = j.parts([text_[k].as_py() for k in own], mine, broken) if any(broken) else mine
                parts.extend(got)
                ends.append(ends[-1] + sum(map(len, got)))
            flat = np.concatenate([np.asarray(p, np.int32) for p in parts]) if parts else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column("_doc"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=[doc_id, "ids"])

    return whole.mapInArrow(join, f"`{doc_id}` long, ids array<int>")


def token_count(text: Column, name: str = "byte_bpe_50k", folder: str | None = None) -> Column:
    """Tokens in a text; 0 for null and empty."""
    path = rank_file(name, folder)

    @F.pandas_udf("long")
    def count(s):
        enc = encoder(path)
        return s.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).astype("int64")

    return count(text)
