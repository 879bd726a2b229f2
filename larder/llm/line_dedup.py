"""Line deduplication: an exact set-similarity join of the lines of all documents.

A line is the set of its words. A later line is removed if an earlier one of the corpus (smaller
document id, or smaller line number in the same document) has a Jaccard similarity of 0.8 or more.

- Equal sets are found by grouping lines by a 128-bit digest of their words.
- Others share a word among their rarest few (prefix filter). Each distinct set sends those words to
  the word's part; a part pairs sets of like size (length filter) whose words after the shared one
  leave enough overlap (positional filter) and whose parity bitmaps differ in few enough bits.
- One earlier match decides, so a set proposes the likeliest partner of each word's list, and the
  likeliest of these is verified first, on the words themselves. Lists that hold more are set aside; a set whose
  proposal fails gets the others, in rounds, until none is left. So a group of thousands of near
  copies makes a few proposals per line, not all pairs.

Rarity is the word's count over all documents, in hash buckets: any order that all tasks agree on is
exact, rarer first is only faster.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.batches import rows_at_once
from larder.llm.columns import unused
from larder.llm.tokens import hash_words, mix
from larder.operators.ordered import numbered
from larder.runtime import Scratch

SIMILARITY = Fraction(4, 5)
BUCKETS = 1 << 20  # word counts; 4 MB in a task
SEGMENTS = 64  # of the bucket table and of bit tables
BITS = 1 << 23  # of a filter that keeps lines nobody asked for from moving; a false hit only moves a line
PIECE = 1 << 20  # bytes of text worked on at once
ROWS = 2000  # rows that a task holds at once
HELD = 1 << 22  # bytes of text whose lines are deduplicated before their words are sent
PER_PART = 250_000  # words sent to a part, about
PROPOSED, GROWTH = 64, 64  # partners per set and word that the second round tries; times this in each later one
HEAD = 64  # entries of a long list that are compared at once
SURE = 0.5  # of the differing bits allowed: a partner within this share ends the search for a likelier one

_words = np.arange(1, 257, dtype=np.uint16).astype(np.uint8)
_words[[9, 10, 11, 12, 13, 32]] = 0
PARITY = 3  # words of 64 bits in a set's parity
POSTING = [("token", np.uint32), ("n", np.uint32), ("pos", np.uint32), *((f"sig{k}", np.uint64) for k in range(PARITY)), ("digest", np.uint64), ("doc", np.int64), ("line", np.int32)]


@dataclass
class Lines:
    """Lines that have words: place in their documents, and their distinct words in one array."""

    doc: np.ndarray
    line: np.ndarray
    n: np.ndarray
    tokens: np.ndarray

    @property
    def begins(self) -> np.ndarray:
        return np.cumsum(self.n) - self.n

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        begins = self.begins
        return tuple(mix(np.add.reduceat(mix(self.tokens + np.uint64(salt)), begins) + self.n.astype(np.uint64)) for salt in (0x51, 0xA7))

    def parities(self) -> list[np.ndarray]:
        """Each word toggles one of 192 bits: unequal bits of two sets count at most their unequal words."""
        bit, place = np.uint64(1) << (self.tokens & np.uint64(63)), ((self.tokens >> np.uint64(6)) % np.uint64(PARITY)).astype(np.uint8)
        return [np.bitwise_xor.reduceat(np.where(place == k, bit, np.uint64(0)), self.begins) for k in range(PARITY)]


def read_lines(docs: list[int], texts: list[str], least: int) -> Iterator[Lines]:
    """Lines of at least `least` distinct words, of whole texts, a bounded number of bytes at a time."""
    group: list[tuple[int, int, bytes]] = []
    held = 0
    for doc, text in zip(docs, texts, strict=True):
        raw, first = text.encode(), 0
        while raw or not first:
            # A long text is cut at line ends.
            end = len(raw) if len(raw) <= PIECE else raw.find(b"\n", PIECE)
            piece, raw = (raw, b"") if end < 0 or end >= len(raw) else (raw[:end], raw[end + 1 :])
            group.append((doc, first, piece))
            first += piece.count(b"\n") + 1
            held += len(piece)
            if held >= PIECE:
                yield _lines(group, least)
                group, held = [], 0
    if group:
        yield _lines(group, least)


def _lines(group: list[tuple[int, int, bytes]], least: int) -> Lines:
    raw = np.frombuffer(b"\n".join(piece for *_, piece in group), np.uint8)
    ends = np.flatnonzero(raw == 10)
    counts = np.array([piece.count(b"\n") + 1 for *_, piece in group])
    owner = np.repeat(np.arange(len(group)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + np.array([f for _, f, _ in group])[owner]
    starts, _, hashed = hash_words(_words[raw])
    line = np.searchsorted(ends, starts)
    # Lines come in order; the leading bits of a hash order the words of each.
    order = np.argsort((line.astype(np.uint64) << np.uint64(40)) | (hashed >> np.uint64(24)))
    line, hashed = line[order], hashed[order]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (hashed[1:] != hashed[:-1])
    line, hashed = line[new], hashed[new]
    n = np.bincount(line, minlength=len(owner))
    kept = n >= max(1, least)
    at = np.flatnonzero(kept)
    return Lines(np.array([d for d, *_ in group], np.int64)[owner[at]], number[at].astype(np.int32), n[at], hashed[kept[line]])


def _batches(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[Lines]:
    for batch in batches:
        yield from read_lines(batch.column(0).to_pylist(), batch.column(1).to_pylist(), least)


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(BUCKETS - 1)).astype(np.int64)


def _segment_sum(parts: pa.Table) -> pa.Table:
    size = BUCKETS // SEGMENTS
    total = np.zeros(size, np.int64)
    for blob in parts.column("counts").to_pylist():
        at, n = np.frombuffer(blob, np.uint32).reshape(2, -1)
        total[at] += n
    return pa.table({"segment": parts.column("segment").slice(0, 1), "counts": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})


def survey(texts: DataFrame, least: int) -> DataFrame:
    """One pass over all texts: doc, line, d1 and d2 (the digest of its words) of every line, and in other
    rows the words counted by bucket: segment and counts, those above zero."""
    fields = [("doc", pa.int64()), ("line", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), ("segment", pa.int32()), ("counts", pa.binary())]
    schema = pa.schema(fields)

    def rows(**columns: pa.Array) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(n, kind)) for name, kind in fields], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.uint32)
        for lines in _batches(batches, least):
            if len(lines.n):
                np.add.at(total, _bucket(lines.tokens), np.uint32(1))
                d1, d2 = lines.digests()
                yield rows(doc=pa.array(lines.doc), line=pa.array(lines.line), d1=pa.array(d1.view(np.int64)), d2=pa.array(d2.view(np.int64)))
        for segment, part in enumerate(total.reshape(SEGMENTS, -1)):
            at = np.flatnonzero(part)
            if len(at):
                blob = np.concatenate([at.astype(np.uint32), part[at]]).tobytes()
                yield rows(segment=pa.array([segment], pa.int32()), counts=pa.array([blob], pa.binary()))

    return texts.mapInArrow(count, "doc long, line int, d1 long, d2 long, segment int, counts binary")


def word_counts(surveyed: DataFrame) -> np.ndarray:
    """Words of all lines by bucket; 4 MB reach the driver."""
    parts = surveyed.where("segment is not null").select("segment", "counts")
    out = np.zeros((SEGMENTS, BUCKETS // SEGMENTS), np.uint32)
    for row in parts.groupBy("segment").applyInArrow(_segment_sum, "segment int, counts binary").collect():
        out[row.segment] = np.frombuffer(row.counts, np.uint32)
    return out.ravel()


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of equal length, bytes of like weight side by side, compressed."""
    raw = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)
    return np.uint32(len(columns[0])).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob[:4], np.uint32)[0])
    raw = np.frombuffer(pa.decompress(blob[4:], decompressed_size=n * sum(np.dtype(t).itemsize for _, t in POSTING), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for _, kind in POSTING:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def _joined(lines: list[Lines]) -> Lines:
    return Lines(*(np.concatenate([getattr(x, f) for x in lines]) for f in ("doc", "line", "n", "tokens")))


def _first_of_each(lines: Lines) -> tuple[Lines, np.ndarray, list[np.ndarray]]:
    """The earliest line of each set of words, with its digest and parity."""
    (digest, second), sig = lines.digests(), lines.parities()
    order = np.lexsort((lines.line, lines.doc, second, digest))
    new = np.ones(len(order), bool)
    a, b = digest[order], second[order]
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.sort(order[new])
    taken = np.zeros(len(lines.n), bool)
    taken[at] = True
    return Lines(lines.doc[at], lines.line[at], lines.n[at], lines.tokens[np.repeat(taken, lines.n)]), digest[at], [x[at] for x in sig]


def postings(texts: DataFrame, counts: np.ndarray, parts: int, least: int, similarity: Fraction) -> DataFrame:
    """part and blob: the prefix words of the distinct sets of each stretch of text, dealt by word."""
    p, q = similarity.numerator, similarity.denominator

    def send(lines: Lines) -> Iterator[pa.RecordBatch]:
        lines, digest, sig = _first_of_each(lines)
        row = np.repeat(np.arange(len(lines.n)), lines.n)
        # A line's words are in order of their hashes already, which a stable sort keeps among equal counts.
        order = np.argsort((row.astype(np.uint64) << np.uint64(32)) | counts[_bucket(lines.tokens)], kind="stable")
        tokens = lines.tokens[order]
        n = lines.n[row]
        pos = np.arange(len(row)) - np.repeat(lines.begins, lines.n)
        prefix = pos < n - (-(-p * n // q)) + 1
        row, pos, token = row[prefix], pos[prefix], (tokens[prefix] >> np.uint64(32)).astype(np.uint32)
        part = (token.astype(np.uint64) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
        by_part = np.argsort(token)  # a part is a range of words
        edges = np.flatnonzero(np.diff(part[by_part], prepend=-1, append=parts))
        columns = [token, lines.n[row].astype(np.uint32), pos.astype(np.uint32), *(x[row] for x in sig), digest[row], lines.doc[row], lines.line[row]]
        columns = [c[by_part] for c in columns]
        names, blobs = [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            names.append(int(part[by_part[a]]))
            blobs.append(_pack([c[a:b] for c in columns]))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Lines] = []
        size = 0
        for lines in _batches(batches, least):
            if len(lines.n):
                held.append(lines)
                size += PIECE
            if size >= HELD:
                yield from send(_joined(held))
                held, size = [], 0
        if held:
            yield from send(_joined(held))

    return texts.mapInArrow(deal, "part int, blob binary")


def _survivors(cols: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs (i later, j earlier) that share a word pass the length, positional and parity filters, and
    what share of the words in which they may differ does differ at least."""
    ni, nj = cols["n"][i].astype(np.int64), cols["n"][j].astype(np.int64)
    need = -(-p * (ni + nj) // (p + q))  # least overlap
    rest = np.minimum(ni - cols["pos"][i], nj - cols["pos"][j])  # this word and those after it
    allowed, differ = ni + nj - 2 * need, sum(np.bitwise_count(cols[f"sig{k}"][i] ^ cols[f"sig{k}"][j]).astype(np.int64) for k in range(PARITY))
    ok = (differ <= allowed) & (rest >= need) & (np.minimum(ni, nj) * q >= np.maximum(ni, nj) * p)
    return np.flatnonzero(ok), differ[ok] / np.maximum(allowed[ok], 1)


def _list_mates(
    cols: dict[str, np.ndarray], active: np.ndarray, start: np.ndarray, p: int, q: int
) -> Generator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray, None]:
    """(entries, i, j, differ): a head of their lists at a time, the survivors among the earlier list mates j
    of each entry i. The caller sends back which entries are to go on."""
    at = 0
    while len(active):
        going = np.ones(len(active), bool)
        for a in range(0, len(active), 1 << 15):
            own = active[a : a + (1 << 15)]
            low = start[own] + at
            count = np.clip(own - low, 0, HEAD)
            i = np.repeat(own, count)
            j = np.repeat(low, count) + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
            ok, differ = _survivors(cols, i, j, p, q)
            going[a : a + (1 << 15)] = yield own, i[ok], j[ok], differ
        at += HEAD
        active = active[going & (active - start[active] > at)]


def _likeliest(cols: dict[str, np.ndarray], start: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, differ, more): each entry's likeliest surviving list mate, and the entries that may have others."""
    best, score, seen = np.full(len(start), -1), np.full(len(start), np.inf), np.zeros(len(start), np.int64)
    stopped = np.zeros(len(start), bool)
    mates = _list_mates(cols, np.flatnonzero(np.arange(len(start)) > start), start, p, q)
    step = next(mates, None)
    while step is not None:
        own, i, j, differ = step
        np.add.at(seen, i, 1)
        order = np.lexsort((j, differ, i))
        i, j, differ = i[order], j[order], differ[order]
        first = np.ones(len(i), bool)
        first[1:] = i[1:] != i[:-1]
        i, j, differ = i[first], j[first], differ[first]
        better = differ < score[i]
        best[i[better]], score[i[better]] = j[better], differ[better]
        stopped[own] = score[own] <= SURE
        try:
            step = mates.send(~stopped[own])
        except StopIteration:
            step = None
    found = np.flatnonzero(best >= 0)
    return found, best[found], score[found], np.flatnonzero((seen > 1) | stopped)


def _ranked(
    cols: dict[str, np.ndarray], start: np.ndarray, wanted: np.ndarray, p: int, q: int, skip: int, take: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, more): wanted entries' survivors ranked skip to skip + take, earliest first, and the entries with more."""
    none = np.zeros(0, np.int64)
    seen, found, more = np.zeros(len(start), np.int64), [(none, none)], [none]
    mates = _list_mates(cols, np.flatnonzero(wanted & (np.arange(len(start)) > start)), start, p, q)
    step = next(mates, None)
    while step is not None:
        own, i, j, _ = step
        rank = seen[i] + np.arange(len(i)) - np.searchsorted(i, i)  # i is in order
        chosen = (rank >= skip) & (rank < skip + take)
        found.append((i[chosen], j[chosen]))
        more.append(np.unique(i[rank >= skip + take]))
        np.add.at(seen, i, 1)
        try:
            step = mates.send(seen[own] <= skip + take)
        except StopIteration:
            step = None
    i, j = (np.concatenate(c) for c in zip(*found, strict=True))
    return i, j, np.unique(np.concatenate(more))


def _place(doc: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sort keys, the last one first, of places in the corpus: one number for both where it holds them."""
    if len(doc) and (int(doc.max()) - int(doc.min()) >> 40 or int(line.max()) >> 23):
        return line, doc
    return ((doc - doc.min() << 23 | line) if len(doc) else doc,)


def _bit(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return (mix(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + line.astype(np.uint64)) % np.uint64(BITS)).astype(np.int64)


def candidates(posted: DataFrame, similarity: Fraction, skip: int, take: int, only: np.ndarray | None) -> DataFrame:
    """x_doc, x_line, y_doc, y_line: proposals of an earlier y for x; y is null where x may have more of them.
    differ: the least share of the words in which they may differ that does; 0 in later rounds.

    Other rows carry, as part and blob, the lists in which something has more: what the next round reads.
    The first round (only is None) proposes one partner per list, later ones those ranked skip to skip + take.
    """
    p, q = similarity.numerator, similarity.denominator

    def pair(rows: pa.Table) -> pa.Table:
        columns = [np.concatenate(c) for c in zip(*(_unpack(b) for b in rows.column("blob").to_pylist()), strict=True)]
        cols = dict(zip((name for name, _ in POSTING), columns, strict=True))
        order = np.argsort(cols["token"])
        token = cols["token"][order]
        same = token[1:] == token[:-1]
        order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]  # words of one line only pair nothing
        cols = {k: v[order] for k, v in cols.items()}
        order = np.lexsort((*_place(cols["doc"], cols["line"]), cols["token"]))
        cols = {k: v[order] for k, v in cols.items()}
        # Stretches of text have each sent their own first line of a set: the first of these is in front.
        named = mix(cols["digest"] + cols["token"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        first = np.sort(np.unique(named, return_index=True)[1])
        cols = {k: v[first] for k, v in cols.items()}
        doc, line, token = cols["doc"], cols["line"], cols["token"]
        new = np.ones(len(token), bool)
        new[1:] = token[1:] != token[:-1]
        start = np.maximum.accumulate(np.where(new, np.arange(len(token)), 0))
        if only is None:
            i, j, differ, more = _likeliest(cols, start, p, q)
        else:
            i, j, more = _ranked(cols, start, only[_bit(doc, line)], p, q, skip, take)
            differ = np.zeros(len(i))
        pairs, at = np.unique(np.stack([doc[i], line[i], doc[j], line[j]]), axis=1, return_index=True)
        left = np.unique(np.stack([doc[more], line[more]]), axis=1)
        kept = np.isin(start, start[more])
        blobs = [_pack([cols[name][kept] for name, _ in POSTING])] if kept.any() else []
        lead, tail = pairs.shape[1] + left.shape[1], len(blobs)

        def numbers(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
            values = np.concatenate(parts).astype(kind.to_pandas_dtype())
            return pa.concat_arrays([pa.array(values), pa.nulls(lead + tail - len(values), kind)])

        return pa.table(
            {
                "x_doc": numbers([pairs[0], left[0]], pa.int64()),
                "x_line": numbers([pairs[1], left[1]], pa.int32()),
                "y_doc": numbers([pairs[2]], pa.int64()),
                "y_line": numbers([pairs[3]], pa.int32()),
                "differ": numbers([differ[at]], pa.float64()),
                "part": pa.concat_arrays([pa.nulls(lead, pa.int32()), pa.array(rows.column("part").to_pylist()[:tail], pa.int32())]),
                "blob": pa.concat_arrays([pa.nulls(lead, pa.binary()), pa.array(blobs, pa.binary())]),
            }
        )

    return posted.groupBy("part").applyInArrow(pair, "x_doc long, x_line int, y_doc long, y_line int, differ double, part int, blob binary")


def bits_of(lines: DataFrame) -> np.ndarray:
    """A table of BITS flags, set for each (doc, line); 1 MB reaches the driver."""
    size = BITS // SEGMENTS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.unique(_bit(batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            edges = np.searchsorted(bit, np.arange(SEGMENTS + 1) * size)
            rows = [(s, bit[a:b].astype(np.uint32).tobytes()) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
            yield pa.RecordBatch.from_pydict({"segment": [r[0] for r in rows], "flags": [r[1] for r in rows]}, pa.schema([("segment", pa.int32()), ("flags", pa.binary())]))

    def join(parts: pa.Table) -> pa.Table:
        segment, flags = parts.column("segment")[0].as_py(), np.zeros(size, bool)
        for blob in parts.column("flags").to_pylist():
            flags[np.frombuffer(blob, np.uint32).astype(np.int64) - segment * size] = True
        return pa.table({"segment": pa.array([segment], pa.int32()), "flags": [np.packbits(flags).tobytes()]})

    out = np.zeros((SEGMENTS, size), bool)
    schema = "segment int, flags binary"
    for row in lines.mapInArrow(place, schema).groupBy("segment").applyInArrow(join, schema).collect():
        out[row.segment] = np.unpackbits(np.frombuffer(row.flags, np.uint8)).astype(bool)
    return out.ravel()


def _fetch(texts: DataFrame, wanted: np.ndarray) -> DataFrame:
    """doc, line and words (distinct, in order, between spaces) of the lines whose flag is set."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int, bytes]] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):  # texts one by one
                raw = text.as_py().encode()
                ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
                numbers = np.arange(len(ends) + 1, dtype=np.int32)
                for k in np.flatnonzero(wanted[_bit(np.full(len(numbers), doc, np.int64), numbers)]).tolist():
                    line = raw[ends[k - 1] + 1 if k else 0 : ends[k] if k < len(ends) else None]
                    found.append((doc, k, b" ".join(sorted(set(line.split())))))
            columns = zip(*found, strict=True) if found else ([], [], [])
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays[:2], arrays[2].cast(pa.string())], ["doc", "line", "words"])

    return texts.mapInArrow(fetch, "doc long, line int, words string")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("x_doc").alias("doc"), F.col("x_line").alias("line")).unionByName(pairs.select(F.col("y_doc").alias("doc"), F.col("y_line").alias("line")))


class _Words:
    """The words of lines that are compared, read from the texts once: a round only reads lines that no earlier one has."""

    def __init__(self, texts: DataFrame, scratch: Scratch):
        self.texts, self.scratch = texts, scratch
        self.held: DataFrame | None = None
        self.flags = np.zeros(BITS, bool)

    def of(self, pairs: DataFrame) -> DataFrame:
        """doc, line and words of both ends of all pairs, and of others."""
        wanted = bits_of(_ends(pairs))
        new = wanted & ~self.flags
        if self.held is None or new.any():
            found = self.scratch.table(_fetch(self.texts, new))
            self.held = found if self.held is None else self.held.unionByName(found)
            self.flags |= wanted
        return self.held


def _verified(pairs: DataFrame, lines: DataFrame, similarity: Fraction) -> DataFrame:
    """x_doc and x_line of the pairs whose words really are similar enough."""
    x = lines.select(F.col("doc").alias("x_doc"), F.col("line").alias("x_line"), F.col("words").alias("x_words"))
    y = lines.select(F.col("doc").alias("y_doc"), F.col("line").alias("y_line"), F.col("words").alias("y_words"))
    both = pairs.join(x, ["x_doc", "x_line"]).join(y, ["y_doc", "y_line"])
    both = both.select("x_doc", "x_line", F.split("x_words", " ").alias("a"), F.split("y_words", " ").alias("b"))
    overlap = F.size(F.array_intersect("a", "b"))
    union = F.size("a") + F.size("b") - overlap
    return both.where(overlap * similarity.denominator >= union * similarity.numerator).select("x_doc", "x_line").distinct()


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: Fraction = SIMILARITY, min_words: int = 1) -> DataFrame:
    """doc_id and line_no (from 0) of every line that has an earlier match.

    Lines without words, or with fewer than min_words distinct ones, neither match nor are matched.
    Null and empty texts have no lines. Rows without a doc_id take no part: their lines have no place in
    the order. Rows that repeat a doc_id are one document: equal line numbers are no match for each other.
    """
    with rows_at_once(docs.sparkSession, ROWS):
        return _repeated_lines(docs, doc_id, text, similarity, min_words)


def _repeated_lines(docs: DataFrame, doc_id: str, text: str, similarity: Fraction, min_words: int) -> DataFrame:
    scratch = Scratch(docs.sparkSession)
    texts = docs.where(docs[doc_id].isNotNull() & docs[text].isNotNull()).select(docs[doc_id].cast("long").alias("doc"), docs[text].alias("text"))
    surveyed = scratch.table(survey(texts, min_words))
    lines = surveyed.where("doc is not null").select("doc", "line", "d1", "d2")
    size, low, high, longest = lines.agg(F.count("*"), F.min("doc"), F.max("doc"), F.max("line")).first()
    # A place is one number where ids and lines are small enough: these are aggregated by hash, structs by sorting.
    small = size and low >= 0 and not high >> 40 and not longest >> 23

    def place(doc: str, line: str) -> Column:
        return F.shiftleft(doc, 23).bitwiseOR(F.col(line).cast("long")) if small else F.struct(F.col(doc).alias("doc"), F.col(line).alias("line"))

    order = place("doc", "line")
    sets = scratch.table(lines.groupBy("d1", "d2").agg(F.min(order).alias("first")))
    counts = word_counts(surveyed)
    # About a fifth of the words are prefix words, and each line has one more.
    parts = max(64, (int(counts.sum(dtype=np.int64)) // 5 + size) // PER_PART)
    posted = postings(texts, counts, parts, min_words, similarity)
    words = _Words(texts, scratch)
    near = rest = found = None
    skip, take, only = 0, PROPOSED, None
    x, xy = ["x_doc", "x_line"], ["x_doc", "x_line", "y_doc", "y_line"]
    while size:
        before, found = found, scratch.table(candidates(posted, similarity, skip, take, only))
        if before is not None:
            scratch.drop(before)  # the lists that go on are in the new table
        proposed = found.where("y_doc is not null")
        if near is None:
            held = words.of(proposed)
            # One proposal of each set first; what others it has waits for those that fail.
            best = proposed.groupBy(*x).agg(F.min(F.struct("differ", "y_doc", "y_line")).alias("best"))
            tried = scratch.table(best.select(*x, "best.y_doc", "best.y_line"))
            near = scratch.table(_verified(tried, held, similarity))
            rest = scratch.table(proposed.select(*xy).join(near, x, "left_anti").distinct().join(tried, xy, "left_anti"))
            scratch.drop(tried)
        else:
            pairs = scratch.table(proposed.select(*xy).unionByName(rest).distinct().join(near, x, "left_anti"))
            more = scratch.table(near.unionByName(_verified(pairs, words.of(pairs), similarity)))
            scratch.drop(near, rest, pairs)
            near, rest = more, None
        left = scratch.table(found.where("y_doc is null and x_doc is not null").select(*x).distinct().join(near, x, "left_anti"))
        if left.isEmpty():
            break
        skip, take = (0, take) if only is None else (skip + take, take * GROWTH)
        only = bits_of(left)
        scratch.drop(left)
        posted = found.where("blob is not null").select("part", "blob")
        rest = near.select(*x, F.lit(None).cast("long").alias("y_doc"), F.lit(None).cast("int").alias("y_line")).where("false") if rest is None else rest
    if near is not None and rest is not None and not rest.isEmpty():
        near = scratch.table(near.unionByName(_verified(rest, words.of(rest), similarity)))
    later = lines.join(sets, ["d1", "d2"])
    if near is None:
        matched = later.where("false")
    else:
        hit = near.select(place("x_doc", "x_line").alias("x"))
        firsts = sets.join(hit, F.col("first") == F.col("x"), "left_semi").select("first")
        matched = later.join(firsts.select(F.col("first").alias("x")), order == F.col("x"), "left_semi")
    gone = later.where(order > F.col("first")).unionByName(matched)
    result = scratch.table(gone.select(F.col("doc").alias("doc_id"), F.col("line").alias("line_no")).distinct())
    scratch.close(result)
    return result


def _apart(docs: DataFrame, doc_id: str, text: str) -> DataFrame | None:
    """__id, __hash and __doc: a number for each document, in order of ids, if an id stands for several texts."""
    marked = docs.where(docs[doc_id].isNotNull()).select(docs[doc_id].alias("__id"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("__hash"))
    if marked.groupBy("__id").agg(F.min("__hash").alias("low"), F.max("__hash").alias("high")).where("low < high").isEmpty():
        return None
    return numbered(marked.distinct(), [F.col("__id"), F.col("__hash")], "__doc")


def remove_lines(docs: DataFrame, similarity: Fraction = SIMILARITY, min_words: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without their repeated lines; a text whose lines all go is empty. No row goes; null texts stay null.

    A document is an id and a text: rows that repeat an id with another text are documents of their own, in order of the
    hashes of their texts. `n_chars`, where docs has it, counts the characters of the new text.
    """
    number, own, removed, id_, hash_ = unused(docs, "__doc", "__own", "__gone", "__id", "__hash")
    apart = _apart(docs, doc_id, text)
    if apart is None:
        named = docs.withColumn(number, docs[doc_id].cast("long"))
    else:
        apart = apart.select(F.col("__id").alias(id_), F.col("__hash").alias(hash_), F.col("__doc").cast("long").alias(number))
        hashed = F.xxhash64(F.coalesce(docs[text], F.lit("")))
        named = docs.join(apart, (F.col(id_) == docs[doc_id]) & (F.col(hash_) == hashed), "left").drop(id_, hash_)
    gone = repeated_lines(named, number, text, similarity, min_words).groupBy(F.col("doc_id").alias(own)).agg(F.collect_set("line_no").alias(removed))
    joined = named.join(gone, F.col(number) == F.col(own), "left").drop(number, own)
    kept = F.array_join(F.filter(F.split(F.col(f"`{text}`"), "\n", -1), lambda x, k: ~F.array_contains(removed, k)), "\n")
    joined = joined.withColumn(text, F.when(F.col(removed).isNull(), F.col(f"`{text}`")).otherwise(kept)).drop(removed)
    return joined.withColumn("n_chars", F.length(F.col(f"`{text}`")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else joined


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_line_dedup": op4_line_dedup}
SQL: dict[str, str] = {}
