"""Removal of repeated byte strings with suffix arrays.

Every byte covered by a 100-byte string that also starts earlier (smaller id,
or earlier in the same document) is removed. Suffix arrays of the whole corpus
can't be built in one place, so equal strings must meet in one shard first:

1. Anchors. Of the k-grams of a 100-byte window the one of smallest hash is its
   anchor (the leftmost of equals). Equal windows have equal anchors at equal
   offsets. A run of windows with one anchor, about 40 bytes long, is a segment:
   the bytes of all its windows. Windows whose anchor occurs once in the corpus
   are unique and go no further.
2. Equal segments (128-bit digests of content) are pre-aggregated: all but the
   earliest are removed whole. Hot groups of copies shrink to one segment here.
3. Different segments of one anchor may still share windows. They are dealt to
   shards by anchor, their bytes fetched, and each shard builds its suffix array
   by Larsson-Sadakane refinement: sort by eight bytes, then sort only the
   unfinished groups by the rank of the suffix ``h`` bytes on, doubling ``h``. Kasai's common prefixes (capped at the window; many lanes of
   the text at once) mark the runs of equal windows; all but the earliest go.
4. An anchor whose segments exceed a shard (a line that countless documents
   share) is split over several shards. Their sorted lists of earliest windows are then
   merged by binary search, dealt by window digest.

Numpy works on bounded blocks inside tasks; Spark deals, groups and joins. The
driver gets two counts. Texts are moved only for documents with something to
remove.

Defined results: null text is empty; texts shorter than the window lose
nothing. Rows of one id and one text are one document. Different texts of one id,
and different texts without id, are documents of their own (``numbered``). Null
ids come before all others, in order of their texts' MD5; an id stands for its
text of smallest MD5, and its other texts come behind all ids, in order of id
and MD5. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import hashing
from quarry.llm.common import ROW, staged, with_row_key
from quarry.plans.sketch import key_sketch, maybe_in

WINDOW = 100
GRAM = 24  # bytes of an anchor, a multiple of 8
SHARD_BYTES = 2 << 20  # text of a shard
MERGE_ROWS = 200_000  # windows of a merging task
LANES = 4096
_C = np.random.default_rng(21).integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_INVERSE = np.uint64(pow(int(hashing.K), -1, 1 << 64))
_inverses = np.ones(1, np.uint64)


def inverses(n: int) -> np.ndarray:
    """1, K**-1, K**-2, ... modulo 2**64."""
    global _inverses
    if len(_inverses) < n:
        _inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 20), _INVERSE, np.uint64)]))
    return _inverses[:n]


def words8(data: np.ndarray, n: int, order: str = "<u8") -> np.ndarray:
    """The eight bytes from each of the first n places on (data is padded)."""
    out = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        m = len(out[o::8])
        out[o::8] = np.frombuffer(data, order, m, o)
    return out


def segments(group: list[bytes], window: int = WINDOW, gram: int = GRAM):
    """Segments of some texts: (text number, first window's start, windows, anchor, digest)."""
    sizes = np.array([len(g) for g in group], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    data = b"\xff".join([*group, b"\0" * (gram + 8)])
    n = int(starts[-1] + sizes[-1]) if len(group) else 0
    if n < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    w = words8(np.frombuffer(data, np.uint8), n + gram - 8)
    h = w[:n] * _C[0]
    for j in range(8, gram, 8):
        h += w[j:n + j] * _C[j // 8]
    h = hashing.mix(h)
    low = np.uint64(0xFFFFFFFF)  # the place below, so that the leftmost of equal hashes wins
    v = (h & ~low) | np.arange(n, dtype=np.uint64)
    width, span = window - gram + 1, 1
    while 2 * span <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    if span < width:
        v = np.minimum(v[:len(v) - (width - span)], v[width - span:])
    anchor = (v & low).astype(np.int64)  # of the window at each place
    last = sizes - window  # last start of a window in its text
    text = np.repeat(np.arange(len(group)), sizes + 1)[:len(anchor)]
    valid = np.arange(len(anchor)) <= (starts + last)[text]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    if not len(first):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    edge = np.flatnonzero(np.concatenate([new | ~valid, [True]]))
    count = edge[np.searchsorted(edge, first, "right")] - first
    total = np.concatenate([[np.uint64(0)], np.cumsum((np.frombuffer(data, np.uint8, n).astype(np.uint64) + np.uint64(1)) * hashing.powers(n))])
    digest = hashing.mix((total[first + count + window - 1] - total[first]) * inverses(n)[first]) ^ hashing.mix(count.astype(np.uint64))
    return text[first], first - starts[text[first]], count, h[anchor[first]], digest


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Places of ``data`` in the order of their suffixes (Larsson-Sadakane)."""
    n = len(data)
    key = words8(np.concatenate([data, np.zeros(16, np.uint8)]), n, ">u8")
    sa = np.argsort(key)
    sorted_key = key[sa]
    head = np.ones(n + 1, bool)
    head[1:n] = sorted_key[1:] != sorted_key[:-1]
    rank = np.zeros(n + 1, np.int64)  # 0 for the end, below every other rank
    rank[sa] = np.maximum.accumulate(np.where(head[:n], np.arange(n), 0)) + 1
    h = 8
    while len(open_ := np.flatnonzero(~(head[:n] & head[1:]))):  # members of groups of two or more
        at = sa[open_]
        key = rank[at] << 32 | rank[np.minimum(at + h, n)]
        order = np.argsort(key)
        key = key[order]
        sa[open_] = at = at[order]
        changed = np.concatenate([[True], key[1:] != key[:-1]])
        head[open_[changed]] = True
        rank[at] = np.maximum.accumulate(np.where(changed, open_, 0)) + 1
        h *= 2
    return sa


def common_prefixes(data: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """Kasai's common prefixes (at most ``cap``) of each suffix and the one before it in ``sa``.

    The text is cut into lanes that advance together; within a lane the prefix of
    the next place is at least that of this one less one.
    """
    n = len(data)
    padded = np.concatenate([data.astype(np.int16), -1 - np.arange(cap + 1, dtype=np.int16) % 2])
    before = np.full(n, n, np.int64)
    before[sa[1:]] = sa[:-1]
    lcp = np.zeros(n, np.int64)
    lane = max(1, -(-n // LANES))
    place = np.arange(0, n, lane)
    end = np.minimum(place + lane, n)
    h = np.zeros(len(place), np.int64)
    while len(place):
        other = before[place]
        more = (h < cap) & (other < n)
        more &= padded[place + h] == padded[np.minimum(other + h, n + cap)]
        more &= (place + h < n) & (other + h < n)
        h += more
        done = np.flatnonzero(~more)
        lcp[place[done]] = h[done]
        place[done] += 1
        h[done] = np.maximum(h[done] - 1, 0)
        if (live := place < end).sum() < len(place):
            place, end, h = place[live], end[live], h[live]
    return lcp[sa]


def earliest_windows(pieces: list[bytes], counts: np.ndarray, window: int = WINDOW):
    """For segments in order of (id, start): is each of their windows a repeat?

    Returns (repeat flags, owner of each window, offset of each window)."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    data = np.frombuffer(b"\xff".join(pieces), np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    owner = np.repeat(np.arange(len(pieces)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    sa = suffix_array(data)
    lcp = common_prefixes(data, sa, window)
    group = np.flatnonzero(lcp < window)  # heads of runs of equal windows
    first = np.minimum.reduceat(sa, group)
    repeat = np.ones(len(data), bool)
    repeat[first] = False
    return repeat[starts[owner] + offset], owner, offset


def runs(flags: np.ndarray, owner: np.ndarray, offset: np.ndarray, window: int):
    """Maximal runs of flagged windows: (owner, first offset, end of the covered bytes)."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, at
    new = np.concatenate([[True], (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]])])
    a, b = at[new], at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]
    return owner[a], offset[a], offset[b] + window


def merged_spans(at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that some spans cover; spans that touch are one run."""
    order = np.argsort(at, kind="stable")
    at, reach = at[order], np.maximum.accumulate(to[order])
    new = np.ones(len(at), bool)
    new[1:] = at[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return at[first], reach[np.append(first[1:], len(at)) - 1]


def merged_earliest(lists: list[tuple]) -> list[np.ndarray]:
    """Which entries of some sorted lists of (digest, order) are repeats.

    Lists are merged one by one by binary search in what is merged so far."""
    out = [np.zeros(len(d), bool) for d, _ in lists]
    digest, order = np.zeros(0, lists[0][0].dtype), np.zeros(0, np.int64)
    source = np.zeros((0, 2), np.int64)
    for k, (d, o) in enumerate(lists):
        at = np.searchsorted(digest, d)
        known = at < len(digest)
        known[known] = digest[at[known]] == d[known]
        here, there = np.flatnonzero(known), at[known]
        later = o[here] > order[there]
        out[k][here[later]] = True
        won, lost = here[~later], there[~later]
        for list_no, i in source[lost]:
            out[list_no][i] = True
        order[lost], source[lost] = o[won], np.stack([np.full(len(won), k), won], 1)
        new = np.flatnonzero(~known)
        digest = np.insert(digest, at[new], d[new])
        order = np.insert(order, at[new], o[new])
        source = np.insert(source, at[new], np.stack([np.full(len(new), k), new], 1), axis=0)
    return out


def numbered(docs: DataFrame) -> DataFrame:
    """own_id, doc_id, text: ``doc_id`` is now one number for each different (own_id, text), in the defined order."""
    keyed = with_row_key(docs.select("doc_id", "text"))
    number = F.when(F.col("doc_id").isNull(), F.col(ROW) + F.lit(-(1 << 63))).otherwise(F.col(ROW))
    return keyed.select(F.col("doc_id").alias("own_id"), number.alias("doc_id"), "text")


def in_pieces(group: list[bytes], window: int = WINDOW, size: int = hashing.LONG) -> Iterator[tuple]:
    """``segments`` of some texts; a long one in pieces that overlap, each window in one of them."""
    if sum(map(len, group)) <= size:
        yield segments(group, window)
        return
    for k, text in enumerate(group):
        for first in range(0, max(1, len(text) - window + 1), size):
            _, at, n, anchor, digest = segments([text[first:first + size + window - 1]], window)
            yield np.full(len(at), k), at + first, n, anchor, digest


def anchors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The anchors of all documents, with their counts per block of texts."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, group in hashing.blocks(batch.column(0).to_pylist()):
                for found in in_pieces(group, window):
                    anchor, n = np.unique(found[3], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n)], ["anchor", "n"])

    return docs.select("text").mapInArrow(emit, "anchor long, n long")


def located_segments(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """anchor, digest, doc_id, at, n of all segments."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, group in hashing.blocks(batch.column(1).to_pylist()):
                for text, at, n, anchor, digest in in_pieces(group, window):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64)), batch.column(0).take(pa.array(text + base)),
                         pa.array(at), pa.array(n)], ["anchor", "digest", "doc_id", "at", "n"])

    return docs.select("doc_id", "text").mapInArrow(emit, f"anchor long, digest long, doc_id {id_type}, at long, n long")


def cut_out(places: DataFrame, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``places`` (doc_id, at, n, shard, split, anchor) with the bytes of each segment."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    wanted = places.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n", "shard", "split")).alias("cuts"))  # at most a text's windows
    texts = maybe_in(docs.select("doc_id", "text"), key_sketch(places, "doc_id"), "doc_id").dropDuplicates(["doc_id"])
    both = texts.join(wanted.withColumnRenamed("doc_id", "w_doc"), F.col("doc_id").eqNullSafe(F.col("w_doc"))).select("doc_id", "text", "cuts")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (text, cuts) in enumerate(zip(batch.column(1), batch.column(2))):
                data, cuts = (text.as_py() or "").encode("utf-8", "surrogatepass"), cuts.values
                at, n = cuts.field("at").to_pylist(), cuts.field("n").to_pylist()
                pieces = [data[a:a + k + window - 1] for a, k in zip(at, n)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.full(len(at), i))), cuts.field("at"), cuts.field("n"), cuts.field("shard"),
                     cuts.field("split"), pa.array(pieces, pa.binary())], ["doc_id", "at", "n", "shard", "split", "bytes"])

    return both.mapInArrow(emit, f"doc_id {id_type}, at long, n long, shard long, split boolean, bytes binary")


def in_order(table: pa.Table) -> pa.Table:
    return table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("at", "ascending")], null_placement="at_start"))


def repeats_in_shards(cuts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Suffix arrays of all shards: repeated stretches (kind 0: doc_id, at, to) and,
    of anchors split over shards, the earliest windows (kind 1: doc_id, at, digest)."""
    id_type = cuts.schema["doc_id"].dataType.simpleString()

    def shard(table: pa.Table) -> pa.Table:
        table = in_order(table)
        pieces, n, at = table["bytes"].to_pylist(), table["n"].to_numpy(), table["at"].to_numpy()
        flags, owner, offset = earliest_windows(pieces, n, window)
        who, a, b = runs(flags, owner, offset, window)
        split = table["split"].to_numpy(zero_copy_only=False)
        own = np.flatnonzero(~flags & split[owner])
        digests = [hashlib.blake2b(pieces[o][k:k + window], digest_size=16).digest() for o, k in zip(owner[own], offset[own])]
        rows = pa.array(np.concatenate([who, owner[own]]))
        return pa.table({"kind": np.repeat(np.array([0, 1], np.int32), [len(who), len(own)]),
                         "doc_id": table["doc_id"].combine_chunks().take(rows),
                         "at": np.concatenate([at[who] + a, at[owner[own]] + offset[own]]),
                         "to": np.concatenate([at[who] + b, at[owner[own]] + offset[own] + window]),
                         "shard": np.concatenate([np.zeros(len(who), np.int64), np.resize(table["shard"].to_numpy()[:1], len(own))]),
                         "digest": pa.array([None] * len(who) + digests, pa.binary())})

    return cuts.groupBy("shard").applyInArrow(shard, f"kind int, doc_id {id_type}, at long, to long, shard long, digest binary")


def merged_across(windows: DataFrame, parts: int) -> DataFrame:
    """The repeats (doc_id, at, to) among the earliest windows of several shards."""
    id_type = windows.schema["doc_id"].dataType.simpleString()

    def merge(table: pa.Table) -> pa.Table:
        table = in_order(table)
        digest = np.array(table["digest"].to_pylist(), "S16")  # fixed width; trailing zeros are no loss at one width
        shard, order = table["shard"].to_numpy(), np.arange(len(table))
        lists, rows = [], []
        for s in np.unique(shard):
            mine = np.flatnonzero(shard == s)
            mine = mine[np.argsort(digest[mine], kind="stable")]
            rows.append(mine)
            lists.append((digest[mine], order[mine]))
        late = np.concatenate([r[f] for r, f in zip(rows, merged_earliest(lists))])
        return table.take(pa.array(late)).select(["doc_id", "at", "to"])

    part = F.pmod(F.xxhash64("digest"), F.lit(parts))
    return (windows.select("doc_id", "at", "to", "shard", "digest", part.alias("part"))
            .groupBy("part").applyInArrow(merge, f"doc_id {id_type}, at long, to long"))


def repeats(docs: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """All repeated stretches (doc_id, at, to); they overlap."""
    common = staged(anchors(docs, window).groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "anchors")
    found = staged(maybe_in(located_segments(docs, window), key_sketch(common, "anchor"), "anchor"), "segments")
    firsts = found.groupBy("anchor", "digest").agg(F.min(F.struct("doc_id", "at", "n")).alias("first"), F.count(F.lit(1)).alias("copies"))
    firsts = staged(firsts.select("anchor", "digest", "first.*", "copies"), "firsts")
    many = firsts.where("copies > 1").select("anchor", "digest", F.col("doc_id").alias("f_doc"), F.col("at").alias("f_at"))
    copies = (found.join(many, ["anchor", "digest"])
              .where(~(F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("at") == F.col("f_at"))))
              .select("doc_id", "at", (F.col("at") + F.col("n") + (window - 1)).alias("to")))
    mixed = (firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("n") + window).alias("bytes"))
             .where("kinds > 1").drop("kinds"))
    several = staged(firsts.join(mixed, "anchor").select("anchor", "digest", "doc_id", "at", "n", "bytes"), "several")
    size = several.agg(F.coalesce(F.sum(F.col("n") + window), F.lit(0)).alias("bytes")).first()["bytes"]
    shards = max(1, -(-int(size) // shard_bytes))
    is_split = F.col("bytes") > shard_bytes
    salt = F.when(is_split, F.pmod("digest", F.ceil(F.col("bytes") / F.lit(shard_bytes)))).otherwise(F.lit(0))
    dealt = several.select("doc_id", "at", "n", is_split.alias("split"),
                           F.when(is_split, -1 - F.abs(F.xxhash64("anchor", salt) % (1 << 62)))
                           .otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards))).alias("shard"))
    judged = staged(repeats_in_shards(cut_out(dealt, docs, window), window), "judged")
    windows = judged.where("kind = 1")
    parts = max(1, -(-windows.count() // MERGE_ROWS))
    return (copies.unionByName(judged.where("kind = 0").select("doc_id", "at", "to"))
            .unionByName(merged_across(windows, parts)))


def deduplicated(docs: DataFrame, window: int = WINDOW, **sizes) -> DataFrame:
    """doc_id, kept (bytes), n_bytes, n_removed, n_spans of the ``numbered`` documents that lose something."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    marks = staged(repeats(docs, window, **sizes), "repeats")
    spans = marks.groupBy("doc_id").agg(F.collect_list(F.struct("at", "to")).alias("spans"))  # at most a text's windows
    texts = maybe_in(docs.select("doc_id", "text"), key_sketch(marks, "doc_id"), "doc_id").dropDuplicates(["doc_id"])
    both = texts.join(spans.withColumnRenamed("doc_id", "s_doc"), F.col("doc_id").eqNullSafe(F.col("s_doc"))).select("doc_id", "text", "spans")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (text, spans) in enumerate(zip(batch.column(1), batch.column(2))):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                a, b = merged_spans(spans.values.field("at").to_numpy(), spans.values.field("to").to_numpy())
                kept = b"".join(data[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(data)]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.array([kept], pa.binary()), pa.array([len(data)]),
                     pa.array([int((b - a).sum())]), pa.array([len(a)])], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return both.mapInArrow(emit, f"doc_id {id_type}, kept binary, n_bytes long, n_removed long, n_spans long")


def report(docs: DataFrame, window: int = WINDOW, **sizes) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = numbered(docs)
    cut = deduplicated(docs, window, **sizes).select(F.col("doc_id").alias("c_doc"), "n_removed", "n_spans", F.sha2("kept", 256).alias("c_sha"))
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = docs.select("own_id", "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    zero = F.lit(0).cast("long")
    return whole.join(cut, F.col("doc_id") == F.col("c_doc"), "left").select(
        F.col("own_id").alias("doc_id"), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("c_sha", "sha").alias("kept_sha256"))
