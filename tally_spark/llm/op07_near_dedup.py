"""Near-duplicate detection by ProbMinHash over weighted word shingles.

1. Documents with equal word sequences form one class, whose representative alone goes on: copies cost one row each.
2. A representative's shingles (SHINGLE words) with their counts as weights give a ProbMinHash signature: each shingle is
   a Poisson process whose rate is its weight; its arrivals fall on random components, and each component keeps its
   first. Processes run in rounds over all documents of a slice at once, and a shingle's process ends early once its
   next arrival is later than all components of its document. Equal components estimate the probability Jaccard
   similarity, which for equal weights is the Jaccard similarity.
3. Bands of ROWS components are the candidate search: representatives that agree in a band share a bucket. One with
   repeated shingles has a second signature and bands with weight 1 for each, so that both similarities are searched.
   Buckets with the same members are one.
4. First, all members of a bucket are compared with its first, exactly, on the texts. Buckets whose members then are of
   one class are done, and so are those of two members. In the others, shingles that no other member of an open bucket
   has are counted, and members that for them alone can't reach the threshold leave.
5. What is left is compared in waves. A member's wave is drawn from its number, so that a wave has GROWTH times as many
   pivots of a bucket as the one before. Pivots meet the members of later waves, and of their own, if these are of other
   classes, and if two bounds don't rule a link out: that of shingles no other has, and that of bits in which parity
   bitmaps of the shingle sets differ (each differing shingle turns one bit at most). A pair is compared in the first of
   the buckets it shares only. Each wave's links join classes, and buckets of one class leave. So each pair of a bucket is
   compared, or is of one class already, or is ruled out; what is lost is only what no band found.
6. Links between classes are contracted after each wave, and joined by minimum label with pointer jumping.

The bounds, for shared shares a and b of the two weights: the similarity is at most 1 / (1 / a + 1 / b - 1), for counted
shingles as for the set (for the set, a and b are shares of the numbers). A set pair whose bitmaps differ in h bits has at
least h differing shingles; of counted ones each weighs at least 1.

The link test takes the larger of the probability Jaccard similarity and the Jaccard similarity of the shingle sets, so a
pair counts if either definition has it.

Defined results: null text is empty; documents without words form one class; a document of fewer than SHINGLE words has
its whole text as one shingle. A null identifier is smaller than any other. Identifiers may be null or repeated: rows are
told apart by identifier and text digest. Of each class one row is kept, the one with the smallest identifier, then
digest. An empty table gives an empty result. Other columns aren't read, whatever their names. Words are runs of letters,
digits and non-ASCII characters after lower-casing A-Z.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .shared import drop, only, row_mark, saved

SHINGLE, THRESHOLD = 5, 0.8
#: Twenty-five bands of four: a pair at the threshold is missed with a chance of 2e-6.
BANDS, ROWS = 25, 4
#: How many times the pivots of a wave are those of the one before, and the words of a parity bitmap.
GROWTH, BITMAP_WORDS = 8, 8


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = W.LOWERED[data]
    starts, ends, text_of = W.spans(low, at, W.NOT_ALNUM)
    return W.word_hashes(low, starts, ends), text_of


def shingles(data: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles as (text, hash, count), sorted by text and hash."""
    hashes, text_of = _words(data, at)
    inside = W.whole_grams(text_of, size)
    grams, owner = W.gram_hashes(hashes, size)[inside], text_of[: len(inside)][inside]
    n = len(at) - 1
    length = np.bincount(text_of, minlength=n)
    short = np.flatnonzero((length > 0) & (length < size))
    if len(short):
        first = W.bounds(text_of, n)
        whole = np.array([W.gram_hashes(hashes[first[i] : first[i + 1]], int(length[i]))[0] for i in short.tolist()], dtype=np.uint64)
        grams, owner = np.concatenate([grams, whole]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    runs = np.flatnonzero(new)
    return owner[runs], grams[runs], np.diff(np.append(runs, len(grams)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def signatures(data: np.ndarray, at: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """A signature for each text (the hash that came first in each component), and which texts have shingles."""
    return _signed(*shingles(data, at), len(at) - 1, components)


def _signed(owner: np.ndarray, grams: np.ndarray, weight: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    first = np.full(n * components, np.inf)
    winner = np.zeros(n * components, np.uint64)
    time = np.zeros(len(grams))
    latest = np.full(n, np.inf)
    step = 0
    while len(grams):
        step += 1
        draw = W.mix(grams + np.uint64(step * W.BASE % (1 << 64)))
        time = time - np.log(_uniform(draw)) / weight
        live = time < latest[owner]
        owner, grams, weight, time, draw = owner[live], grams[live], weight[live], time[live], draw[live]
        slot = owner * components + (W.mix(draw ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(components)).astype(np.int64)
        # of arrivals in one slot the earliest comes last, and so stays
        late_first = np.lexsort((grams, -time)) if step == 1 else np.argsort(-time, kind="stable")
        s, t, g = slot[late_first], time[late_first], grams[late_first]
        better = t < first[s]
        s, t, g = s[better], t[better], g[better]
        first[s] = t
        winner[s] = g
        latest = first.reshape(n, components).max(axis=1)
    return winner.reshape(n, components), np.isfinite(latest)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Probability Jaccard and Jaccard similarity of two sorted shingle arrays with counts."""
    (x, v), (y, w) = a, b
    if not len(x) or not len(y):
        return 0.0, 0.0
    place = np.searchsorted(y, x)
    both = np.flatnonzero(y[np.minimum(place, len(y) - 1)] == x)
    if not len(both):
        return 0.0, 0.0
    union = len(x) + len(y) - len(both)
    p, q = v[both] / v.sum(), w[place[both]] / w.sum()
    only_p, only_q = 1 - p.sum(), 1 - q.sum()
    ratio = p / q
    order = np.argsort(ratio)
    p, q, ratio = p[order], q[order], ratio[order]
    # for a shared shingle of ratio r: the sum over all of max(p, q * r), divided by p
    low_q = np.cumsum(q)
    high_p = p.sum() - np.cumsum(p)
    total = only_p + only_q * ratio + high_p + low_q * ratio
    return float(np.minimum((p / total).sum(), 1.0)), len(both) / union


def _digest(text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), 256))


def _represent(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """_id, _digest (of the text), _sha (of the word sequence) and _bands (bucket numbers) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.pieces(batches, "_text"):
            data, at = W.text_view(b.column(1))
            low = W.LOWERED[data]
            starts, ends, text_of = W.spans(low, at, W.NOT_ALNUM)
            # separators become single spaces, so equal word sequences give equal bytes
            out = low.copy()
            out[W.NOT_ALNUM[low]] = 0x20
            raw, first = out.tobytes(), W.bounds(text_of, len(at) - 1)
            shas = [hashlib.blake2b(b" ".join(raw[starts[f] : ends[z - 1]].split()) if z > f else b"", digest_size=16).digest() for f, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(shas, pa.binary()), _bands(data, at, bands, rows)], ["_id", "_digest", "_sha", "_bands"])

    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"), _digest(text_col).alias("_digest"))
    return own.mapInArrow(run, "_id long, _digest binary, _sha binary, _bands array<long>")


def _band_keys(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.zeros((len(found), bands), np.uint64)
    for i in range(rows):
        key = W.mix(key * np.uint64(W.BASE) + found[:, i::rows])
    return W.mix(key + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(W.BASE))


def _bands(data: np.ndarray, at: np.ndarray, bands: int, rows: int) -> pa.ListArray:
    """Bucket numbers of each text: of its counted shingles, and of their set where these differ. None without words."""
    owner, grams, weight = shingles(data, at)
    n = len(at) - 1
    found, some = _signed(owner, grams, weight, n, bands * rows)
    keep = np.flatnonzero(some)
    key = _band_keys(found[keep], bands, rows)
    # without repeated shingles both signatures are the same
    several = np.bincount(owner[weight > 1], minlength=n) > 0
    own, texts = several[owner], np.flatnonzero(several)
    place = np.cumsum(several) - 1
    of_set, _ = _signed(place[owner[own]], grams[own], np.ones(int(own.sum())), len(texts), bands * rows)
    key_of_set = _band_keys(of_set, bands, rows)
    # texts in keep are ascending and have all of texts
    more = key_of_set != key[np.searchsorted(keep, texts)]
    text_of = np.concatenate([np.repeat(keep, bands), np.repeat(texts, more.sum(axis=1))])
    order = np.argsort(text_of, kind="stable")
    return pa.ListArray.from_arrays(pa.array(W.bounds(text_of[order], n), pa.int32()), pa.array(np.concatenate([key.ravel(), key_of_set[more]])[order].view(np.int64)))


def _linked(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that are links. A pair meets first one text, then the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, tuple | None] = (None, None)
        for batch in batches:
            a, b, ta, tb = (batch.column(i) for i in range(4))
            link = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                number = a[i].as_py()
                if last[0] != number:
                    last = (number, shingles(*W.text_view(ta.slice(i, 1)))[1:])
                link[i] = max(similarity(last[1], shingles(*W.text_view(tb.slice(i, 1)))[1:])) >= threshold
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(link))

    one = pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    two = one.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    return saved(two.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), "links")


def _hashed(texts: DataFrame) -> DataFrame:
    """hash, rep and w (count) of each distinct shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.pieces(batches, "text"):
            owner, grams, weight = shingles(*W.text_view(b.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), b.column(0).take(pa.array(owner)), pa.array(weight, pa.int64())], ["hash", "rep", "w"])

    return texts.select("rep", "text").mapInArrow(run, "hash long, rep long, w long")


def _measured(texts: DataFrame) -> DataFrame:
    """rep, n (distinct shingles), w (all) and m0, m1 and so on: a bitmap of the parity of shingles on each bit."""
    names = [f"m{i}" for i in range(BITMAP_WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = 64 * BITMAP_WORDS
        for b in W.pieces(batches, "text"):
            owner, grams, weight = shingles(*W.text_view(b.column(1)))
            n = b.num_rows
            slot = owner * bits + (W.mix(grams) % np.uint64(bits)).astype(np.int64)
            odd = (np.bincount(slot, minlength=n * bits) & 1).astype(np.uint8)
            words = np.packbits(odd.reshape(n, bits), axis=1).view(np.int64)
            sizes = [np.bincount(owner, minlength=n), np.bincount(owner, weights=weight, minlength=n)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x.astype(np.int64)) for x in sizes], *[pa.array(np.ascontiguousarray(words[:, i])) for i in range(BITMAP_WORDS)]], ["rep", "n", "w", *names])

    return texts.select("rep", "text").mapInArrow(run, ", ".join(["rep long", "n long", "w long", *[f"{x} long" for x in names]]))


def _crowded(members: DataFrame, several: str) -> DataFrame:
    """bucket, size and first (smallest rep) of the buckets for which the aggregate several holds; one of those with equal members."""
    seen = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("first"), F.bit_xor(F.xxhash64("rep")).alias("_x"), F.bit_xor(F.xxhash64("rep", F.lit(7))).alias("_y"), F.expr(several).alias("_open"))
    return seen.filter("_open").groupBy("size", "first", "_x", "_y").agg(F.min("bucket").alias("bucket")).select("bucket", "size", "first")


def _several(members: DataFrame) -> DataFrame:
    """The buckets whose members have several labels; stored, so that a join with it has a shuffle of its own on both sides and can be split where a bucket is large."""
    return saved(members.groupBy("bucket").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).filter("_low < _high").select("bucket"), "several")


def _rivals(play: DataFrame, wave: int, threshold: float) -> DataFrame:
    """a and b of the pairs that a wave has to compare. play: bucket, rep, label, wave, n, w, un, uw, m0 and so on, buckets."""
    least = (1 + 1 / threshold) * (1 + 1e-12)
    # buckets of one class have no pivots any more
    several = _several(play)
    pivots = play.filter(F.col("wave") == wave).join(several, "bucket", "left_semi")
    one = saved(pivots.select(*[F.col(c).alias(f"p_{c}") for c in play.columns]), "pivots")
    drop(several)
    differ = " + ".join(f"bit_count(m{i} ^ p_m{i})" for i in range(BITMAP_WORDS))
    test = f"""label <> p_label AND (wave > p_wave OR rep > p_rep)
        AND (((n + p_n) / cast(least(n - un, p_n - p_un) as double) <= {least!r}D AND ({differ}) <= (n + p_n) * {(1 - threshold) / (1 + threshold) * (1 + 1e-12)!r}D)
          OR ((n < w OR p_n < p_w) AND w / cast(w - uw as double) + p_w / cast(p_w - p_uw as double) <= {least!r}D
            AND (w + p_w - ({differ})) * {least!r}D >= power(sqrt(w) + sqrt(p_w), 2)))
        AND bucket = array_min(array_intersect(buckets, p_buckets))"""
    met = play.filter(F.col("wave") >= wave).join(one, (F.col("bucket") == F.col("p_bucket")) & F.expr(test))
    pairs = saved(met.select(F.least("rep", "p_rep").alias("a"), F.greatest("rep", "p_rep").alias("b")), "pairs")
    drop(one)
    return pairs


def _relabelled(df: DataFrame, moved: DataFrame) -> DataFrame:
    """df with its labels as moved (node, label) has them."""
    to = moved.select(F.col("node").alias("_node"), F.col("label").alias("_to"))
    return df.join(to, F.col("label") == F.col("_node"), "left").withColumn("label", F.coalesce("_to", "label")).select(*df.columns)


def _wave_of(threshold_size: str) -> Column:
    """The wave of a member of a bucket: the first that has about GROWTH, in the next GROWTH times as many, and so on."""
    share = f"(shiftrightunsigned(xxhash64(rep, 11), 1) / {float(1 << 63)!r}D)"
    return F.expr(f"cast(greatest(0D, ceil(ln(greatest({share} * {threshold_size}, 1e-9D)) / {float(np.log(GROWTH))!r}D) - 1) as int)")


def labels(reps: DataFrame, texts_of, threshold: float = THRESHOLD) -> DataFrame:
    """node and label (the smallest of its class) of those representatives (rep, _bands) that share a bucket. texts_of: gives rep and text for a table of rep."""
    every = reps.select("rep", F.explode("_bands").alias("bucket"))
    crowded = saved(_crowded(every, "count(1) > 1"), "crowded")
    members = saved(every.join(crowded, "bucket").select("bucket", "rep", "first", "size"), "members")
    drop(crowded)
    texts = saved(texts_of(members.select("rep").distinct()), "texts")
    pairs = saved(members.filter("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    found = classes(_linked(pairs, texts, threshold))
    label = saved(members.select(F.col("rep").alias("node")).distinct().join(found.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("node", F.coalesce("label", "node").alias("label")), "label")
    # a bucket's first has met all others of it
    left = members.filter("size > 2 AND rep <> first").select("bucket", "rep").join(label, F.col("rep") == F.col("node")).select("bucket", "rep", "label")
    left = saved(left, "left")
    several = _several(left)
    left, before = saved(left.join(several, "bucket", "left_semi"), "open"), left
    for x in (pairs, members, found, before, several):
        drop(x)
    if not left.limit(1).count():
        return label
    own = saved(texts.join(left.select("rep").distinct(), "rep", "left_semi"), "open-texts")
    alone = _hashed(own).groupBy("hash").agg(F.count(F.lit(1)).alias("_n"), F.min("rep").alias("rep"), F.min("w").alias("w")).filter("_n = 1").groupBy("rep").agg(F.count(F.lit(1)).alias("un"), F.sum("w").alias("uw"))
    stats = _measured(own).join(alone, "rep", "left").fillna(0, ["un", "uw"])
    able = saved(stats.filter(f"n - un >= n * {threshold * (1 - 1e-12)!r}D OR w - uw >= w * {threshold * (1 - 1e-12)!r}D"), "able")
    live = saved(left.join(able.select("rep"), "rep", "left_semi"), "live")
    drop(left)
    sized = saved(_crowded(live, "min(label) < max(label)").select("bucket", "size"), "sized")
    live = saved(live.join(sized, "bucket"), "sized-live")
    # at most two for each band
    shared = live.groupBy("rep").agg(F.collect_list("bucket").alias("buckets"))
    play = saved(live.join(shared, "rep").join(able, "rep").withColumn("wave", _wave_of("size")).drop("size"), "play")
    for x in (live, sized, able):
        drop(x)
    last = play.agg(F.max("wave")).first()[0]
    for wave in range(0 if last is None else last + 1):
        pairs = _rivals(play, wave, threshold)
        links = _linked(pairs, own, threshold) if pairs.limit(1).count() else pairs
        if pairs.limit(1).count() and links.limit(1).count():
            at = label.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
            ends = links.join(at, F.col("a") == F.col("_node")).select(F.col("_label").alias("a"), "b").join(at, F.col("b") == F.col("_node")).select("a", F.col("_label").alias("b"))
            moved = classes(ends.distinct())
            label, before = saved(_relabelled(label, moved), "label"), label
            # a wave's pivots have met all they had to
            play, old = saved(_relabelled(play.filter(F.col("wave") > wave), moved), "play"), play
            for x in (before, old, moved):
                drop(x)
        drop(pairs)
    for x in (play, own, texts):
        drop(x)
    return label


def classes(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node of its class) for all nodes of edges (a, b), by minimum label and pointer jumping."""
    both = saved(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    found = saved(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        least = both.join(found, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("_near"))
        # stored, so that the join below can be split where very many have one label
        pushed = saved(found.join(least, F.col("node") == F.col("a")).select("node", "label", F.least("label", "_near").alias("_new")), "pushed")
        # a label's own label: chains shorten by half in each round
        jumped = pushed.join(pushed.select(F.col("node").alias("_n"), F.col("_new").alias("_up")), F.col("_new") == F.col("_n"), "left").select("node", "label", F.coalesce(F.least("_up", "_new"), "_new").alias("_new"))
        after = saved(jumped, "labels")
        for x in (found, pushed):
            drop(x)
        found = after.select("node", F.col("_new").alias("label"))
        if not after.filter("label <> _new").limit(1).count():
            drop(both)
            return found


def _grouped(docs: DataFrame, id_col: str, text_col: str, threshold: float, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row for each _id and _digest: _rep (_id and _digest of the first of those with equal words), _first (of its class), _same (equal rows)."""
    wordings = saved(_represent(docs, id_col, text_col, bands, rows), "wordings")
    # a wording is named by a number of its own, stored: identifiers may be null or repeated
    best = saved(wordings.groupBy("_sha").agg(F.min(F.struct("_id", "_digest")).alias("_rep"), F.any_value("_bands").alias("_bands")).withColumn("rep", F.monotonically_increasing_id()), "best")

    def texts_of(wanted: DataFrame) -> DataFrame:
        own = docs.select(F.col(f"`{id_col}`").cast("long").alias("_own"), _digest(text_col).alias("_text_digest"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
        named = best.join(wanted, "rep", "left_semi").select("rep", F.col("_rep._id").alias("_rep_id"), F.col("_rep._digest").alias("_rep_digest"))
        # repeated rows, of one text: one is enough
        return own.join(named, (F.col("_text_digest") == F.col("_rep_digest")) & F.col("_own").eqNullSafe(F.col("_rep_id"))).select("rep", "text").dropDuplicates(["rep"])

    label = labels(best.select("rep", "_bands"), texts_of, threshold)
    grouped = saved(best.join(label, F.col("rep") == F.col("node"), "left").select("_sha", "_rep", F.coalesce("label", "rep").alias("label")), "grouped")
    first = saved(grouped.groupBy("label").agg(F.min("_rep").alias("_first")), "first")
    group = grouped.join(first, "label").select("_sha", "_rep", "_first")
    counted = wordings.groupBy("_sha", "_id", "_digest").agg(F.count(F.lit(1)).alias("_same"))
    out = saved(counted.join(group, "_sha").drop("_sha"), "groups")
    for x in (wordings, best, label, grouped, first):
        drop(x)
    return out


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: id, rep_id (smallest identifier of those with equal words), class_id (smallest of the class), kept (exactly one row of each class)."""
    each = _grouped(docs, id_col, text_col, threshold).select("*", F.explode(F.sequence(F.lit(1), F.col("_same").cast("int"))).alias("_nth"))
    kept = F.struct("_id", "_digest").eqNullSafe(F.col("_first")) & (F.col("_nth") == 1)
    return each.select(F.col("_id").alias(id_col), F.col("_rep._id").alias("rep_id"), F.col("_first._id").alias("class_id"), kept.alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first row of docs of each class, with all its columns. Nulls, repeated rows and clashing names as above."""
    firsts = _grouped(docs, id_col, text_col, THRESHOLD).select(F.col("_first._id").alias("_id"), F.hex("_first._digest").alias("_hex")).distinct()
    return only(docs, firsts.select(row_mark(F.col("_id"), F.col("_hex")).alias("_kept")), row_mark(F.col(f"`{id_col}`").cast("long"), F.hex(_digest(text_col))))
