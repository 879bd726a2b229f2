"""N-gram Jaccard join: documents whose sets of word n-grams are similar enough, by a join of prefix trees.

- A set can only link if that share of its n-grams also occurs in other sets. Most documents have too few such
  n-grams, and drop out: stretches of documents send hashes of theirs, each but once, to parts by hash, and get
  back which others have too. What is dropped has too few for certain; hashes that collide only keep a set.
- The sets left are put in one global order of n-grams, hot ones last. Two similar sets share one of their first few
  n-grams: each sends those, with its size and their places. The place of a set's n-gram bounds the size of what it can
  be similar to through it. What shares n-grams and fits in size, over any number of steps, is a family: every link
  lies inside one.
- A task stores the whole sets of a family in a trie, commonest n-gram first. Each set walks the trie from its
  root: the overlap gathered on a path is shared by all sets below it, and a subtree is left as soon as this
  overlap and what remains, of the walking set and of the longest set below, can't reach the overlap needed.
- Large families are dealt to blocks of bounded size. Each block also holds the family's HUBS, the sets with
  the smallest share of n-grams of their own, so the blocks of a group of near copies are tied together. What
  still shares n-grams across blocks, and is not connected yet, meets one set of the largest group of each n-gram in
  turn, and only what no turn connects all the others that it may be similar to; these at once where they are few.

Links that connect sets are wanted, not all pairs: subtrees whose sets are all connected with the walking set
are left too. So a group of thousands of near copies takes a walk per set, not all pairs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.simhash import LOWER, connected
from larder.llm.tokens import hash_words, mix
from larder.runtime import Scratch

WORDS, SIMILARITY = 4, Fraction(85, 100)
BUCKETS, SEGMENTS = 1 << 22, 64  # n-gram counts by hash; 4 MB of classes go to every task
STRETCH = 1 << 21  # n-grams of documents that are sent to the parts together
PER_PART = 1 << 21  # n-grams of a part, about
FLAGS = 1 << 24  # bits that keep other documents' sets from moving; a false hit only moves a set
PIECE = 1 << 20  # bytes of text worked on at once
BLOCK_SETS, BLOCK_GRAMS = 512, 1 << 20  # sets and n-grams of a block, about
BIN_GRAMS = 1 << 21  # n-grams of a task's blocks, about
HUBS = 8  # sets of a large family that all its blocks hold
PARTNERS = 256  # sets that one set is compared with in a block of later rounds, about
STARS = 2  # rounds in which what is not connected meets one set of each n-gram's largest group
LOOKED, FEW = 512, 8  # pairs looked at for each n-gram sent, and pairs left for each set, up to which all meet at once

_letters = np.arange(1, 257, dtype=np.uint16).astype(np.uint8)
_letters[[9, 10, 11, 12, 13, 32]] = 0
_space = re.compile(rb"[\x09-\x0D\x20]")
_FRACTION = np.uint64((1 << 56) - 1)


def grams_of(text: str, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of all runs of `words` words, A-Z in lower case; a shorter text is one run."""
    raw, hashes, at = text.encode().translate(LOWER), [], 0
    while at < len(raw):
        cut = _space.search(raw, at + PIECE)  # a long text is cut at white space
        end = cut.start() if cut else len(raw)
        hashes.append(hash_words(_letters[np.frombuffer(raw[at:end], np.uint8)])[2])
        at = end
    hashed = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    length = min(words, len(hashed))
    if not length:
        return hashed
    run = np.full(len(hashed) - length + 1, np.uint64(length))
    for k in range(length):
        run = mix(run * np.uint64(0xD6E8FEB86659FD93) + hashed[k : k + len(run)])
    return np.unique(run)


def node_of(grams: np.ndarray) -> int:
    """The 64-bit name of a set: equal sets have equal names."""
    total = np.add.reduce(mix(grams + np.uint64(0x51))) + np.uint64(len(grams))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def keys_of(grams: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """N-grams in global order: the class of their bucket leads their hash."""
    found = classes[_bucket(grams)].astype(np.uint64)
    return np.sort(found << np.uint64(56) | grams >> np.uint64(8))


def prefix_of(n: int, similarity: Fraction) -> int:
    return n - -(-similarity.numerator * n // similarity.denominator) + 1


def needed(n, m, similarity: Fraction):
    """The least overlap of similar sets of n and m."""
    p, q = similarity.numerator, similarity.denominator
    return -(-p * (n + m) // (p + q))


def _packed(*columns: np.ndarray) -> bytes:
    """32-bit columns of equal length, bytes of like weight side by side, compressed."""
    raw = b"".join(np.ascontiguousarray(c.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns)
    return np.array([len(columns[0])], np.uint32).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes, columns: int) -> list[np.ndarray]:
    n = int(np.frombuffer(blob[:4], np.uint32)[0])
    raw = np.frombuffer(pa.decompress(blob[4:], decompressed_size=4 * n * columns, codec="zstd", asbytes=True), np.uint8)
    return [np.ascontiguousarray(part.reshape(4, n).T).view(np.uint32).ravel() for part in raw.reshape(columns, 4 * n)]


NOBODY = 0xFFFFFFFF  # an n-gram that several sets of one stretch have
ENTRIES, REPLY, INDEX = range(3)  # kinds of blobs: n-grams and their sets; how many n-grams of a set others have; the sets of a stretch


def _stretch(sets: dict[int, np.ndarray], home: int, bits: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(part, stretch, kind, blob): what a stretch of distinct sets sends."""
    nodes, sizes = np.array(list(sets), np.int64), np.array([len(g) for g in sets.values()], np.uint32)
    owner = np.repeat(np.arange(len(nodes), dtype=np.uint32), sizes)
    grams = np.concatenate(list(sets.values()))
    order = np.argsort(grams)
    grams, owner = grams[order], owner[order]
    first = np.ones(len(grams), bool)
    first[1:] = grams[1:] != grams[:-1]
    group = np.cumsum(first) - 1
    several = np.bincount(group) > 1
    inside = np.bincount(owner[several[group]], minlength=len(nodes))
    grams, owner = grams[first], np.where(several, NOBODY, owner[first]).astype(np.uint32)
    part = (grams >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.diff(part, prepend=-1, append=1 << bits))
    named = int(mix(np.array([np.add.reduce(mix(nodes.view(np.uint64))) + np.uint64(home)], np.uint64)).view(np.int64)[0])
    short = (grams >> np.uint64(32 - bits)).astype(np.uint32)  # the 32 bits after those that name the part
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(part[a]), named, ENTRIES, _packed(short[a:b], owner[a:b])
    low, high = nodes.view(np.uint64) & np.uint64(0xFFFFFFFF), nodes.view(np.uint64) >> np.uint64(32)
    parts = np.full(len(nodes), len(edges) - 1)
    yield home, named, INDEX, _packed(low, high, sizes, inside, parts)


_BLOBS = pa.schema([("part", pa.int32()), ("stretch", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])


def supported(texts: DataFrame, words: int, similarity: Fraction) -> DataFrame:
    """node of the sets of which so many n-grams occur in other sets too that they may be similar to one.

    A stretch that has not heard from all its parts, as after a loss of tasks whose rows came in another order, keeps
    its sets. Sets with copies in other stretches are kept too.
    """
    letters = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(24, max(3, int(letters / 6 / PER_PART).bit_length()))  # a word has about six letters and blanks
    p, q = similarity.numerator, similarity.denominator

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        home = (context.partitionId() if context else 0) % (1 << bits)
        seen: set[int] = set()
        held: dict[int, np.ndarray] = {}
        size = 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*_stretch(held, home, bits), strict=True), _BLOBS.types, strict=True)], schema=_BLOBS)

        for batch in batches:
            for text in batch.column(0):
                grams = grams_of(text.as_py(), words)
                node = node_of(grams)
                if len(grams) and node not in seen:
                    seen.add(node)
                    held[node] = grams
                    size += len(grams)
                    if size >= STRETCH:
                        yield rows()
                        held, size = {}, 0
        if held:
            yield rows()

    def reply(rows: pa.Table) -> pa.Table:
        kinds, stretches, blobs = (rows.column(c).to_pylist() for c in ("kind", "stretch", "blob"))
        out = [(s, k, b) for s, k, b in zip(stretches, kinds, blobs, strict=True) if k == INDEX]
        sent = [(s, *_unpacked(b, 2)) for s, k, b in zip(stretches, kinds, blobs, strict=True) if k == ENTRIES]
        if sent:
            grams = np.concatenate([g for _, g, _ in sent])
            owner = np.concatenate([o for *_, o in sent])
            order = np.argsort(grams)
            first = np.ones(len(grams), bool)
            first[1:] = grams[order][1:] != grams[order][:-1]
            group = np.cumsum(first) - 1
            several = (np.bincount(group) > 1) | (np.bincount(group, owner[order] == NOBODY) > 0)
            shared = np.zeros(len(grams), bool)
            shared[order] = several[group]
            shared &= owner != NOBODY
            at = 0
            for s, g, _ in sent:
                own, counts = np.unique(owner[at : at + len(g)][shared[at : at + len(g)]], return_counts=True)
                out.append((s, REPLY, _packed(own, counts)))
                at += len(g)
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["stretch", "kind", "blob"])

    def add(rows: pa.Table) -> pa.Table:
        kinds, blobs = rows.column("kind").to_pylist(), rows.column("blob").to_pylist()
        index = [_unpacked(b, 5) for k, b in zip(kinds, blobs, strict=True) if k == INDEX]
        if not index:
            return pa.table([pa.array([], pa.int64())], ["node"])
        low, high, sizes, inside, parts = index[0]
        total, replies = inside.astype(np.int64), 0
        for own, counts in (_unpacked(b, 2) for k, b in zip(kinds, blobs, strict=True) if k == REPLY):
            total[own] += counts
            replies += 1
        enough = total * q >= sizes.astype(np.int64) * p if replies >= parts[0] else np.ones(len(total), bool)
        nodes = (high[enough].astype(np.uint64) << np.uint64(32) | low[enough].astype(np.uint64)).view(np.int64)
        return pa.table([pa.array(nodes)], ["node"])

    sent = texts.select("text").mapInArrow(send, "part int, stretch long, kind int, blob binary")
    replied = sent.groupBy("part").applyInArrow(reply, "stretch long, kind int, blob binary")
    return replied.groupBy("stretch").applyInArrow(add, "node long").distinct()


def _flag(nodes: np.ndarray) -> np.ndarray:
    return (mix(nodes.view(np.uint64) + np.uint64(0x35)) % np.uint64(FLAGS)).astype(np.int64)


def flags_of(nodes: DataFrame) -> np.ndarray:
    """FLAGS flags, set for each node; FLAGS / 8 bytes reach the driver."""
    size = FLAGS // SEGMENTS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flag = np.unique(_flag(batch.column(0).to_numpy()))
            edges = np.searchsorted(flag, np.arange(SEGMENTS + 1) * size)
            found = [(s, (flag[a:b] - s * size).astype(np.uint32).tobytes()) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
            yield pa.RecordBatch.from_pydict({"segment": [f[0] for f in found], "flags": [f[1] for f in found]}, pa.schema([("segment", pa.int32()), ("flags", pa.binary())]))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, segment = np.zeros(size, bool), None
        for batch in batches:
            segment = batch.column("segment")[0].as_py()
            for blob in batch.column("flags"):
                flags[np.frombuffer(blob.as_py(), np.uint32)] = True
        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([np.packbits(flags).tobytes()], pa.binary())], ["segment", "flags"])

    out = np.zeros((SEGMENTS, size // 8), np.uint8)
    schema = "segment int, flags binary"
    for row in nodes.mapInArrow(place, schema).groupBy("segment").applyInArrow(join, schema).collect():
        out[row.segment] = np.frombuffer(row.flags, np.uint8)
    return out.ravel()


def survey(texts: DataFrame, flags: np.ndarray, words: int) -> DataFrame:
    """doc_id, node and n of every row, and the n-grams, as bytes, of the sets whose flag is set, once in a task."""
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("grams", pa.binary())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            held, size, at = [], 0, 0
            for k, text in enumerate(batch.column(1)):
                grams = grams_of(text.as_py(), words)
                node = node_of(grams)
                flag = int(_flag(np.array([node], np.int64))[0])
                wanted = len(grams) and node not in seen and flags[flag >> 3] >> (7 - (flag & 7)) & 1
                if wanted:
                    seen.add(node)
                    size += len(grams)
                held.append((node, len(grams), grams.tobytes() if wanted else None))
                if size >= STRETCH or k == batch.num_rows - 1:  # a bounded number of bytes goes out at once
                    columns = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(held)), *columns], schema=schema)
                    held, size, at = [], 0, k + 1

    return texts.mapInArrow(mark, "doc_id long, node long, n int, grams binary")


def hot_classes(sets: DataFrame) -> np.ndarray:
    """A class of each bucket of n-grams, 0 unless more sets have them than chance puts there.

    At most 4 * BUCKETS bytes reach the driver, compressed; it unpacks a segment at a time.
    """
    size = BUCKETS // SEGMENTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            for blob in batch.column(0):
                np.add.at(total, _bucket(np.frombuffer(blob.as_py(), np.uint64)), np.uint32(1))
        for segment, part in enumerate(total.reshape(SEGMENTS, -1)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([_packed(part)], pa.binary())], ["segment", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, segment = np.zeros(size, np.int64), None
        for batch in batches:
            segment = batch.column("segment")[0].as_py()
            for blob in batch.column("counts"):
                total += _unpacked(blob.as_py(), 1)[0]
        total = np.minimum(total, 2**32 - 1)
        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([_packed(total)], pa.binary()), pa.array([int(total.sum())])], ["segment", "counts", "total"])

    counted = sets.select("grams").mapInArrow(count, "segment int, counts binary").groupBy("segment")
    rows = counted.applyInArrow(add, "segment int, counts binary, total long").collect()
    usual = sum(row.total for row in rows) / BUCKETS
    limit = usual + 6 * np.sqrt(usual) + 8
    classes = np.zeros((SEGMENTS, size), np.uint8)
    for row in rows:
        found = _unpacked(row.counts, 1)[0]
        hot = np.flatnonzero(found > limit)
        classes[row.segment, hot] = np.minimum(1 + 8 * np.log2(found[hot] / limit), 255).astype(np.uint8)
    return classes.ravel()


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(8)) & np.uint64(BUCKETS - 1)


def ordered_sets(sets: DataFrame, classes: np.ndarray) -> DataFrame:
    """node and grams: keys in global order, as bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [keys_of(np.frombuffer(g.as_py(), np.uint64), classes).tobytes() for g in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], ["node", "grams"])

    return sets.select("node", "grams").mapInArrow(read, "node long, grams binary")


def postings(sets: DataFrame, classes: np.ndarray, similarity: Fraction) -> DataFrame:
    """key, node, n and pos: the first n-grams of each set, and their places."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(g.as_py()) // 8 for g in batch.column(1)], np.int32)
            keys = [keys_of(np.frombuffer(g.as_py(), np.uint64), classes)[: prefix_of(int(n), similarity)] for g, n in zip(batch.column(1), sizes, strict=True)]
            lengths = np.array([len(k) for k in keys], np.int64)
            if len(keys):
                pos = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                columns = [np.concatenate(keys).view(np.int64), np.repeat(batch.column(0).to_numpy(), lengths), np.repeat(sizes, lengths), pos.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "n", "pos"])

    return sets.select("node", "grams").mapInArrow(send, "key long, node long, n int, pos int")


@dataclass
class Node:
    """A trie node without branches: the sets low to high (in order of their sequences) share `grams` after its parent's."""

    low: int
    high: int
    grams: np.ndarray
    least: int  # size of the smallest set below
    remains: int  # n-grams of the longest sequence below, after this node
    children: list


def build_trie(sequences: list[np.ndarray], sizes: np.ndarray) -> Node:
    """The trie of sorted sequences."""
    shared = np.zeros(len(sequences), np.int64)  # first places that each shares with the one before it
    for k in range(1, len(sequences)):
        a, b = sequences[k - 1], sequences[k]
        short = min(len(a), len(b))
        differ = a[:short] != b[:short]
        at = int(differ.argmax()) if short else 0
        shared[k] = at if short and differ[at] else short
    lengths = np.array([len(s) for s in sequences])

    def node(low: int, high: int, depth: int) -> Node:
        end = int(shared[low + 1 : high].min()) if high - low > 1 else len(sequences[low])
        return Node(low, high, sequences[low][depth:end], int(sizes[low:high].min()), int(lengths[low:high].max()) - end, [])

    root = node(0, len(sequences), 0)
    open_ = [(root, 0)]
    while open_:
        at, depth = open_.pop()
        depth += len(at.grams)
        if at.high - at.low > 1:
            edges = [at.low, *(at.low + 1 + np.flatnonzero(shared[at.low + 1 : at.high] == depth)).tolist(), at.high]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                child = node(low, high, depth)
                at.children.append(child)
                open_.append((child, depth))
    return root


def trie_links(keys: list[np.ndarray], sizes: np.ndarray, walks: np.ndarray, similarity: Fraction) -> list[tuple[int, int]]:
    """Index pairs of similar sets that connect each walking set with all it is similar to, over one or more links.

    keys: n-grams of each set in global order; sizes: their numbers; walks: which sets walk. Distinct sets.
    """
    whole, place, held = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    common = held[place] > 1  # an n-gram of one set only adds to no overlap
    rank = len(whole) - 1 - place  # commonest first
    ends = np.cumsum([len(k) for k in keys])
    kept = [rank[a:b][common[a:b]][::-1] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    p, q = similarity.numerator, similarity.denominator
    able = [k for k, s in enumerate(kept) if len(s) * q >= int(sizes[k]) * p]
    if len(able) < 2:
        return []
    if len(able) == 2:
        a, b = able
        overlap = len(np.intersect1d(kept[a], kept[b], assume_unique=True))
        return [(a, b)] if (walks[a] or walks[b]) and overlap >= needed(int(sizes[a]), int(sizes[b]), similarity) else []
    order = sorted(able, key=lambda k: kept[k].astype(">u4").tobytes())
    sequences, sized = [kept[k] for k in order], np.array([int(sizes[k]) for k in order])
    root = build_trie(sequences, sized)
    group, done = np.arange(len(order)), np.zeros(len(order), bool)
    inside, links = np.zeros(len(whole), bool), []
    # Sets with the fewest n-grams of their own first: they connect the most.
    turns = sorted((i for i, k in enumerate(order) if walks[k]), key=lambda i: (sized[i] - len(sequences[i])) / sized[i])
    for i in turns:
        own, size = sequences[i], int(sized[i])
        inside[own] = True
        done[i] = True
        stack = [(root, 0, len(own))]
        while stack:
            at, overlap, left = stack.pop()
            if (done[at.low : at.high] | (group[at.low : at.high] == group[i])).all():
                continue
            if len(at.grams):
                overlap += int(np.count_nonzero(inside[at.grams]))
                left = len(own) - int(np.searchsorted(own, at.grams[-1], "right"))
            if overlap + min(left, at.remains) < needed(size, at.least, similarity):
                continue
            if at.children:
                stack += [(child, overlap, left) for child in at.children]
            elif overlap >= needed(size, int(sized[at.low]), similarity):
                links.append((order[i], order[at.low]))
                group[group == group[at.low]] = group[i]
        inside[own] = False
    return links


def block_links(members: DataFrame, bins: int, similarity: Fraction) -> DataFrame:
    """a, b: links found in each block of members (family, block, node, walks, grams). Each block's sets are one
    task's, a block after the other."""

    def of_block(rows: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
        found = {node: (walks, grams) for node, walks, grams in sorted(rows, key=lambda r: r[:2])}
        nodes, keys = list(found), [np.frombuffer(g, np.uint64) for _, g in found.values()]
        pairs = trie_links(keys, np.array([len(k) for k in keys]), np.array([w for w, _ in found.values()]), similarity)
        ends = [(min(nodes[i], nodes[j]), max(nodes[i], nodes[j])) for i, j in pairs]
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.int64()) for k in (0, 1)], ["a", "b"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, rows = None, []
        for batch in batches:
            for family, block, node, walks, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (family, block) != name:
                    if len(rows) > 1:
                        yield of_block(rows)
                    name, rows = (family, block), []
                rows.append((node, walks, grams))
        if len(rows) > 1:
            yield of_block(rows)

    dealt = members.select("family", "block", "node", "walks", "grams").repartition(bins, "family", "block")
    return dealt.sortWithinPartitions("family", "block").mapInArrow(join, "a long, b long")


def _edges(shared: DataFrame, similarity: Fraction) -> DataFrame:
    """a, b: edges over which all that may be similar hangs together.

    n-gram number i of a set of n lets it be similar, from there on, to a set of at most (n - i) * (p + q) / p - n. Of
    two similar sets the larger is within that bound of the smaller at the first n-gram they share. So sizes are cut to
    levels, a set goes to all from its own to that of its bound, and what shares n-gram and level is tied by a star.
    """
    p, q = similarity.numerator, similarity.denominator
    steps = F.lit(2 / max(-math.log(p / q), 1 / 32))  # two levels or so from a set's size to that of the largest similar one
    most = F.floor((F.col("n").cast("long") - F.col("pos")) * (p + q) / p) - F.col("n")
    first, last = (F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) * steps) for size in (F.col("n"), most))
    dealt = shared.select("key", "node", F.explode(F.sequence(first, F.greatest(first, last))).alias("level"))
    low = dealt.groupBy("key", "level").agg(F.min("node").alias("a"))
    return dealt.join(low, ["key", "level"]).where("a <> node").select("a", F.col("node").alias("b")).distinct()


def _spread(column: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(column, F.lit(11)), blocks).cast("int")


def _placed(shared: DataFrame, families: DataFrame) -> DataFrame:
    """node, family, block, blocks, hub: the block of each set; hubs are in all blocks of a large family."""
    sets = shared.groupBy("node").agg(F.max("n").alias("n"), F.min(F.col("pos") / F.col("n")).alias("own"))
    named = sets.join(families.withColumnRenamed("root", "family"), "node")
    sized = named.groupBy("family").agg(F.count("*").alias("sets"), F.sum("n").alias("grams"))
    blocks = F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("grams") / BLOCK_GRAMS)).cast("int")
    sized = sized.select("family", blocks.alias("blocks"))
    given = named.join(sized, "family")
    turn = F.expr("row_number() over (partition by family order by own, node)")
    hubs = given.where("blocks > 1").withColumn("turn", turn).where(F.col("turn") <= HUBS).select("node", F.lit(True).alias("hub"))
    given = given.join(hubs, "node", "left").withColumn("hub", F.coalesce("hub", F.lit(False)))
    return given.select("node", "n", "own", "family", "blocks", "hub", _spread("node", F.col("blocks")).alias("block"))


def _apart(shared: DataFrame, placed: DataFrame, groups: DataFrame) -> DataFrame:
    """The n-grams of large families that several groups share: key, family, node, n, pos, own, block, root, and main, the
    largest group of key and family.

    Hubs have met their whole family, and are left out.
    """
    large = placed.where("blocks > 1 and not hub").select("node", "own", "family", "block")
    held = shared.join(large, "node").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sized = held.groupBy("key", "family", "root").count().groupBy("key", "family")
    main = sized.agg(F.max(F.struct("count", "root")).alias("main"), F.count("*").alias("groups")).where("groups > 1")
    return held.join(main.select("key", "family", F.col("main.root").alias("main")), ["key", "family"])


def _may_link(similarity: Fraction) -> Column:
    """What sizes and places of a shared n-gram leave open, for a and b that are not connected and have not met."""
    p, q = similarity.numerator, similarity.denominator
    most = F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos"))
    enough = most * (p + q) >= (F.col("a_n") + F.col("b_n")) * p
    return (F.col("a_root") != F.col("b_root")) & (F.col("a_block") != F.col("b_block")) & enough


def _side(held: DataFrame, side: str) -> DataFrame:
    return held.select("key", "family", "main", *[F.col(c).alias(f"{side}_{c}") for c in ("node", "n", "pos", "block", "root")])


def _star(held: DataFrame, turn: int, similarity: Fraction) -> DataFrame:
    """a, b: what is outside a key's largest group, beside one set of that group, another in each turn."""
    inside = held.where("root = main").withColumn("rank", F.col("own") if turn == 0 else F.xxhash64("node", F.lit(turn)))
    least = inside.groupBy("key", "family").agg(F.min(F.struct("rank", "node", "n", "pos", "block", "root")).alias("one"))
    one = least.select("key", "family", *[F.col(f"one.{c}").alias(f"b_{c}") for c in ("node", "n", "pos", "block", "root")])
    met = _side(held.where("root <> main"), "a").join(one, ["key", "family"]).where(_may_link(similarity))
    return met.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()


def _all(held: DataFrame, similarity: Fraction) -> DataFrame:
    """a, b: what is outside a key's largest group, beside all other sets of the key; a pair for each key that it shares."""
    a, b = _side(held.where("root <> main"), "a").drop("main"), _side(held, "b")
    once = (F.col("b_root") == F.col("main")) | (F.col("a_node") < F.col("b_node"))
    return a.join(b, ["key", "family"]).where(_may_link(similarity) & once).select(F.col("a_node").alias("b"), F.col("b_node").alias("a"))


def _few(held: DataFrame, similarity: Fraction) -> bool:
    """Whether all pairs left are in proportion to the sets. They are counted, not written."""
    outside = F.count_if(F.col("root") != F.col("main")).cast("decimal(20,0)")
    sized = held.groupBy("key", "family").agg(F.count("*").alias("sent"), (F.count("*") * outside).alias("pairs"))
    sent, most = sized.agg(F.sum("sent"), F.sum("pairs")).first()
    if most > LOOKED * sent:
        return False
    pairs = _all(held, similarity).agg(F.approx_count_distinct(F.xxhash64("a", "b"))).first()[0]
    return pairs <= FEW * held.agg(F.approx_count_distinct("node")).first()[0]


def _compared(pairs: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """a, b: the links among pairs; each b walks through tries of its partners."""
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("blocks"))
    partners = pairs.join(many, "b").select(F.col("b").alias("family"), _spread("a", F.col("blocks")).alias("block"), F.col("a").alias("node"), F.lit(False).alias("walks"))
    walkers = partners.select("family", "block").distinct().select("family", "block", F.col("family").alias("node"), F.lit(True).alias("walks"))
    return block_links(partners.unionByName(walkers).join(sets, "node"), max(8, pairs.count() // PARTNERS), similarity)


def _links(sets: DataFrame, similarity: Fraction, scratch: Scratch) -> DataFrame:
    """a, b: links that connect all sets that similar ones connect. sets: node and grams, each node once."""
    classes = hot_classes(sets)
    posted = scratch.table(postings(sets, classes, similarity))
    several = posted.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    shared = scratch.table(posted.join(several, "key", "left_semi"))
    scratch.drop(posted)
    placed = scratch.table(_placed(shared, connected(_edges(shared, similarity))))
    whole = ordered_sets(sets, classes)
    everywhere = F.when(F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    members = placed.withColumn("block", F.explode(everywhere)).select("node", "family", "block", F.lit(True).alias("walks"))
    grams = placed.agg(F.sum("n")).first()[0] or 0
    links = scratch.table(block_links(members.join(whole, "node"), max(8, grams // BIN_GRAMS), similarity))
    if placed.where("blocks > 1").isEmpty():
        return links
    held = scratch.table(whole.join(placed.where("blocks > 1").select("node"), "node", "left_semi"))
    turn, apart = 0, None
    while True:
        if apart is None:
            apart = scratch.table(_apart(shared, placed, connected(links)))
            if apart.isEmpty():
                return links
        last = turn >= STARS or _few(apart, similarity)
        pairs = scratch.table(_all(apart, similarity).distinct() if last else _star(apart, turn, similarity))
        found = scratch.table(_compared(pairs, held, similarity))
        scratch.drop(pairs)
        if last:
            return links.unionByName(found)
        if found.isEmpty():  # nothing has changed, and another star would hardly find more
            turn = STARS
        else:
            links, turn = links.unionByName(found), turn + 1
            scratch.drop(apart)
            apart = None


def ngram_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: Fraction = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles (size of the row's set of n-grams) and component_id of every row.

    component_id is the smallest doc_id of the group that links connect, the row itself included. Links join
    sets whose Jaccard similarity is `similarity` at least. Null texts count as empty; texts without words
    have no set and link with nothing, not even with each other. A null doc_id names no group: its row links,
    and its component_id is null only if nothing else in the group has an id. Repeated rows give repeated rows;
    of rows that repeat an id with other texts each has its own set. Other columns are not read. Sets are named
    by 64 bits of hash, and n-grams told apart by 56 within a family.
    """
    scratch = Scratch(docs.sparkSession)
    given = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    able = scratch.table(supported(given, words, similarity))
    surveyed = scratch.table(survey(given, flags_of(able), words))
    rows = scratch.table(surveyed.drop("grams"))
    # Copies in other tasks, and sets that a flag let through by chance, go here.
    held = surveyed.where("grams is not null").select("node", "grams").join(able, "node", "left_semi")
    sets = scratch.table(held.groupBy("node").agg(F.first("grams").alias("grams")))
    scratch.drop(surveyed)
    groups = connected(_links(sets, similarity, scratch))
    alone = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
    named = scratch.table(alone.join(groups, "node", "left"))
    # Sets without links know their own smallest id; only linked ones are brought together.
    smallest = named.where("root is not null").groupBy("root").agg(F.min("least").alias("smallest"))
    component = named.join(smallest, "root", "left").select("node", F.coalesce("smallest", "least").alias("component_id"))
    found = rows.join(component, "node").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
    result = scratch.table(found)
    scratch.close(result)
    return result


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_ngram_join": op11_ngram_join}
SQL = {
    "op11_ngram_join": """
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS overlap FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * overlap >= 85 * (x.n + y.n - overlap)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN links ON other = a
)
SELECT documents.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM documents LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.doc_id = documents.doc_id GROUP BY documents.doc_id
"""
}
