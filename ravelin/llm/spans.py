"""Long exact spans shared between documents, by automata over confirmed recurring phrases.

1. Every text is sampled by winnowing: of the PHRASE-long substrings inside each window of `least` code
   points, the one with the smallest hash is an anchor, so a window that two documents share has the same
   anchor phrase in both. Phrases that are anchors in two or more documents are confirmed as recurring.
2. Confirmed phrases are sharded by the place where they come from, so those of one passage are together; a document is
   streamed through the Aho-Corasick automaton of every shard that holds one of its anchors, which locates all occurrences
   of the shard's phrases. A document without a recurring anchor shares no window and is not streamed.
3. The windows of one located anchor are a run; its context, the text they cover, has a 128-bit hash. Contexts that several documents
   hold are shared wholly. Where an anchor has several contexts (at the ends of passages), the windows of one holder of
   each are compared by 128-bit hashes, and the outcome holds for every holder. Runs of shared windows are the spans.

Nothing is paired: a phrase, context or window that a third of all documents hold costs one row per occurrence, and
counts are combined before each shuffle. Texts are worked on many at a time, side by side, and long ones in pieces, so neither
short nor very long texts cost more per character.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, parts

PHRASE = 64
#: Phrases of one automaton, some 3 KB each; code points that one lane streams through it; code points of a block, and of a piece of a long text.
SHARD_PHRASES, LANE_CHARS, BLOCK = 8000, 4_000_000, 1 << 18
#: Code points of the text that one shard key covers.
PASSAGE = 1 << 18
BASES = 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D
#: Bits of a place in a block: less than two blocks and a window.
PLACE = np.uint64(20)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base | 1, pow(base | 1, -1, 1 << 64)):
        p = np.full(n, np.uint64(b))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Sums:
    """A polynomial hash modulo 2^64 of any pieces of codes, from sums over prefixes."""

    def __init__(self, codes: np.ndarray, base: int):
        up, self.down = _powers(base, 1 << max(10, len(codes).bit_length()))
        self.s = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(base)) * up[: len(codes)], out=self.s[1:])

    def pieces(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.s[end] - self.s[start]) * self.down[start])

    def every(self, width: int) -> np.ndarray:
        n = max(0, len(self.s) - width)
        return _mix((self.s[width:] - self.s[:n]) * self.down[:n])


def rolling(codes: np.ndarray, width: int, base: int) -> np.ndarray:
    """The hash of every width-long piece."""
    return Sums(codes, base).every(width)


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """For every run of width hashes, the place of the smallest by its low 44 bits (the first of equals)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, span = (hashes << PLACE) | np.arange(len(hashes), dtype=np.uint64), 1
    while span * 2 <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    best = np.minimum(best[:n], best[width - span : width - span + n])
    return (best & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)


Piece = tuple[int, int, str, int, object]


def _blocks(pieces: Iterable[Piece]) -> Iterator[list[Piece]]:
    block, total = [], 0
    for p in pieces:
        block.append(p)
        total += len(p[2])
        if total >= BLOCK:
            yield block
            block, total = [], 0
    if block:
        yield block


def _cut_text(doc: int, text: str | None, least: int) -> Iterator[Piece]:
    """(doc, offset, piece, length of the text, None): each window of the text is in one piece."""
    n = len(text) if text is not None else 0
    for o in range(0, n - least + 1, BLOCK):
        yield doc, o, text[o : o + BLOCK + least - 1], n, None


class Field:
    """The windows of the texts of a block, which lie side by side, and their anchors."""

    def __init__(self, block: list[Piece], least: int):
        self.sums = Sums(_codes("".join(p[2] for p in block)), BASES[0])
        self.doc = np.array([p[0] for p in block], np.int64)
        self.offset = np.array([p[1] for p in block], np.int64)
        self.length = np.array([p[3] for p in block], np.int64)
        n = np.array([len(p[2]) for p in block], np.int64)
        self.end = np.cumsum(n)
        self.begin = self.end - n
        self.hashes = self.sums.every(min(PHRASE, least))
        place = winnow(self.hashes, least - min(PHRASE, least) + 1)
        self.start = np.flatnonzero(np.repeat(self.end, n)[: len(place)] - np.arange(len(place)) >= least)
        self.anchor = place[self.start]

    def piece(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.end, at, side="right")


def _batch(names: list[str], kinds: list[pa.DataType], columns: list[list[np.ndarray]]) -> pa.RecordBatch:
    flat = [np.concatenate(c) if c else np.empty(0, np.int64) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c).cast(k) for c, k in zip(flat, kinds)], names=names)


def _anchors(least: int):
    """Each document's anchors: a place and the phrase's hash, one row per phrase of a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist())
            for block in _blocks(p for i, t in rows for p in _cut_text(i, t, least)):
                f = Field(block, least)
                at = np.unique(f.anchor)
                piece, h = f.piece(at), f.hashes[at]
                order = np.lexsort((at, h, piece))
                at, piece, h = at[order], piece[order], h[order]
                new = np.ones(len(at), bool)
                new[1:] = (piece[1:] != piece[:-1]) | (h[1:] != h[:-1])
                at, piece, h = at[new], piece[new], h[new]
                for c, x in zip(out, (f.doc[piece], at - f.begin[piece] + f.offset[piece], h, f.length[piece])):
                    c.append(x)
            yield _batch(["_doc", "_at", "_h", "_n"], [pa.int64(), pa.int64(), pa.int64(), pa.int64()], out)

    return run


def _phrases(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shards, phrases = [], []
            for t, gives in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shards.extend(g["_shard"] for g in gives)
                phrases.extend(t[g["_at"] : g["_at"] + width] for g in gives)
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(phrases, pa.string())], names=["_shard", "_text"])

    return run


def _locate(least: int):
    """Rows in: a shard's phrases (doc null, phrase as text) before its documents. Rows out: the runs of windows of each located anchor, with their context's hash."""
    width = min(PHRASE, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        shard, phrases, machine = None, [], None
        for b in batches:
            held: list[Piece] = []
            for s, i, t in zip(b.column("_shard").to_pylist(), b.column("_doc").to_pylist(), b.column("_text").to_pylist()):
                if s != shard:
                    shard, phrases, machine = s, [], None
                if i is None:
                    phrases.append(t)
                    continue
                if machine is None:
                    machine = ahocorasick.Automaton()
                    for p in phrases:
                        machine.add_word(p, 0)
                    machine.make_automaton()
                    phrases = []
                for doc, o, piece, n, _ in _cut_text(i, t, least):
                    located = np.array([e for e, _ in machine.iter(piece)], np.int64) - (width - 1)
                    if len(located):
                        held.append((doc, o, piece, n, located))
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for block in _blocks(held):
                f = Field(block, least)
                hit = np.zeros(len(f.hashes), bool)
                for at, p in zip(f.begin.tolist(), block):
                    hit[p[4] + at] = True
                mine = np.flatnonzero(hit[f.anchor])
                if not len(mine):
                    continue
                start, anchor = f.start[mine], f.anchor[mine]
                turn = np.flatnonzero(anchor[1:] != anchor[:-1])
                first, last = start[np.concatenate([[0], turn + 1])], start[np.concatenate([turn, [len(start) - 1]])]
                anchor, piece = anchor[np.concatenate([[0], turn + 1])], f.piece(first)
                other = Sums(_codes("".join(p[2] for p in block)), BASES[1])
                row = (f.doc[piece], first - f.begin[piece] + f.offset[piece], last - first, f.hashes[anchor], f.sums.pieces(first, last + least), other.pieces(first, last + least))
                for c, x in zip(out, row):
                    c.append(x)
            yield _batch(["_doc", "_f", "_n", "_h", "_a", "_b"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()], out)

    return run


def _windows(least: int):
    """The windows of one holder of each context, by their hashes."""
    names = ["_a", "_b", "_lo", "_hi", "_off", "_wa", "_wb"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())
            out: list[list[np.ndarray]] = [[] for _ in names]
            for block in _blocks((i, 0, t[c["_f"] : c["_f"] + c["_n"] + least], 0, c) for i, t, asked in rows for c in asked):
                block = [p for p in block if len(p[2]) == p[4]["_n"] + least]
                if not block:
                    continue
                codes = _codes("".join(p[2] for p in block))
                x, y = Sums(codes, BASES[0]), Sums(codes, BASES[1])
                n = np.array([p[4]["_n"] + 1 for p in block], np.int64)
                end = np.cumsum(n + least - 1)
                begin = end - (n + least - 1)
                a, b2 = x.pieces(begin, end).view(np.int64), y.pieces(begin, end).view(np.int64)
                # of rows with an equal id the one that has this context
                own = (a == np.array([p[4]["_a"] for p in block])) & (b2 == np.array([p[4]["_b"] for p in block]))
                which = np.repeat(np.flatnonzero(own), n[own])
                off = np.arange(len(which)) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
                at = begin[which] + off
                doc, hi = np.array([p[0] for p in block], np.int64), np.array([p[4]["_hi"] for p in block], np.int64)
                for c, v in zip(out, (a[which], b2[which], doc[which], hi[which], off, x.pieces(at, at + least), y.pieces(at, at + least))):
                    c.append(v)
            yield _batch(names, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()], out)

    return run


def shared_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 200) -> DataFrame:
    """(doc_id, start_char, end_char): the maximal runs of code points that lie in a stretch of `least` consecutive ones which
    another document holds verbatim. Nothing is normalised; end_char is exclusive.

    Cases: null, empty and shorter texts have no span; a passage repeated only inside its own document is not
    shared; equal texts are shared wholly; rows with an equal doc_id are one document, whose texts are treated each by
    itself, and repeated rows change nothing; extra columns are ignored; an empty table gives an empty table.
    """
    src = docs.select(F.col(doc_id).cast("long").alias("_doc"), F.col(text).alias("_text")).where(F.col("_doc").isNotNull() & (F.length("_text") >= least))
    anchors = cut(src.mapInArrow(_anchors(least), "_doc long, _at long, _h long, _n long"))
    known = (
        anchors.groupBy("_h")
        .agg(F.min("_doc").alias("_lo"), F.max("_doc").alias("_hi"), F.min_by("_at", "_doc").alias("_from"))
        .where(F.col("_lo") < F.col("_hi"))
        .drop("_hi")
    )
    known = cut(known)
    shards = max(1, -(-known.count() // SHARD_PHRASES))
    known = known.withColumn("_shard", F.pmod(F.xxhash64("_lo", F.floor(F.col("_from") / PASSAGE)), F.lit(shards)).cast("int"))
    # of each document: the shards that hold one of its anchors, and the phrases that are taken from it
    gives = F.when((F.col("_doc") == F.col("_lo")) & (F.col("_at") == F.col("_from")), F.struct("_shard", "_at"))
    needs = cut(anchors.join(known, "_h").groupBy("_doc").agg(F.collect_set("_shard").alias("_shards"), F.collect_list(gives).alias("_gives"), F.max("_n").alias("_n")))
    # a shard's documents are spread over lanes by their length, each lane with the shard's automaton
    lanes = needs.select(F.explode("_shards").alias("_shard"), "_n").groupBy("_shard").agg((F.floor(F.sum("_n") / LANE_CHARS) + 1).cast("int").alias("_lanes"))
    lanes = cut(lanes)
    held = src.join(needs.select("_doc", "_shards", "_gives"), "_doc")
    texts = held.select("_doc", "_text", F.explode("_shards").alias("_shard")).join(lanes, "_shard")
    texts = texts.select("_shard", F.pmod(F.xxhash64("_doc"), "_lanes").cast("int").alias("_lane"), "_doc", "_text")
    phrases = held.where(F.size("_gives") > 0).select("_text", "_gives").mapInArrow(_phrases(min(PHRASE, least)), "_shard int, _text string")
    phrases = phrases.join(lanes, "_shard").select("_shard", F.explode(F.sequence(F.lit(0), F.col("_lanes") - 1)).alias("_lane"), F.lit(None).cast("long").alias("_doc"), "_text")
    # a task takes several lanes one after the other where there are more than 16 a shuffle partition
    tasks = min(16 * parts(docs.sparkSession), max(1, lanes.agg(F.coalesce(F.sum("_lanes"), F.lit(1))).first()[0]))
    feed = (
        phrases.unionByName(texts)
        .repartition(tasks, "_shard", "_lane")
        .sortWithinPartitions("_shard", "_lane", F.col("_doc").asc_nulls_first())
        .select((F.col("_shard").cast("long") * (1 << 31) + F.col("_lane")).alias("_shard"), "_doc", "_text")
    )
    runs = cut(feed.mapInArrow(_locate(least), "_doc long, _f long, _n int, _h long, _a long, _b long"))

    contexts = runs.groupBy("_a", "_b").agg(F.min("_h").alias("_h"), F.min("_doc").alias("_lo"), F.max("_doc").alias("_hi"), F.min_by("_f", "_doc").alias("_f"), F.min("_n").alias("_n"))
    contexts = cut(contexts)
    several = contexts.groupBy("_h").agg(F.count("*").alias("_many"), F.min("_lo").alias("_x"), F.max("_hi").alias("_y")).where(F.col("_x") < F.col("_y")).select("_h", "_many")
    contexts = cut(contexts.join(several, "_h").drop("_h"))
    wholly = contexts.where(F.col("_lo") < F.col("_hi")).select("_a", "_b", F.lit(0).alias("_x"), F.col("_n").alias("_y"))
    asked = contexts.where(F.col("_many") > 1).groupBy(F.col("_lo").alias("_doc")).agg(F.collect_list(F.struct("_f", "_n", "_a", "_b", "_hi")).alias("_asked"))
    windows = cut(src.join(asked, "_doc").select("_doc", "_text", "_asked").mapInArrow(_windows(least), "_a long, _b long, _lo long, _hi long, _off int, _wa long, _wb long"))
    common = windows.groupBy("_wa", "_wb").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")).where(F.col("_lo") < F.col("_hi")).select("_wa", "_wb")
    # windows of one context lie so near that what is between two shared ones is covered by them
    partly = windows.where(F.col("_lo") == F.col("_hi")).join(common, ["_wa", "_wb"], "left_semi").groupBy("_a", "_b").agg(F.min("_off").alias("_x"), F.max("_off").alias("_y"))
    found = runs.select("_doc", "_f", "_a", "_b").join(wholly.unionByName(partly), ["_a", "_b"]).select("_doc", (F.col("_f") + F.col("_x")).alias("_s"), (F.col("_f") + F.col("_y")).alias("_e"))
    w = Window.partitionBy("_doc").orderBy("_s", "_e")
    before = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("_new", F.coalesce((F.col("_s") - before > least).cast("int"), F.lit(0)))
    found = found.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return found.groupBy("_doc", "_run").agg(F.min("_s").alias("start_char"), (F.max("_e") + least).alias("end_char")).select(
        F.col("_doc").alias(doc_id), "start_char", "end_char"
    )


def shared_fraction(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_fraction) of every document."""
    per = spans.groupBy(doc_id).agg(F.sum(F.col("end_char") - F.col("start_char")).alias("shared_chars"))
    n = F.coalesce(F.length(F.col(text)), F.lit(0)).cast("long")
    return docs.select(doc_id, n.alias("n_chars")).join(per, doc_id, "left").select(
        doc_id,
        "n_chars",
        F.coalesce("shared_chars", F.lit(0)).cast("long").alias("shared_chars"),
        F.when(F.col("n_chars") > 0, F.coalesce("shared_chars", F.lit(0)) / F.col("n_chars")).otherwise(0.0).alias("shared_fraction"),
    )
