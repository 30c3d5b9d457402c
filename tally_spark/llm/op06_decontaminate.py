"""Benchmark decontamination: a prefix-filtered containment join of documents and benchmark windows.

A window is ITEM_WINDOW consecutive words of an item, or all of a shorter one. All of its words have to occur in a
document that contains it, so a prefix of one word is enough, and the rarest word is the best: the words of the windows
are ordered by their count in the whole corpus, and each window is joined to the documents' words by its rarest. The
word's place in the window and in the document fix where the window would have to lie; those that would not fit the
document (positional and length bounds) are left out, and the others are compared word for word.

Documents are read twice, once for the counts and once for the join. There is no shuffle of the documents' words while
the windows are within BROADCAST_BYTES; beyond that both sides are shuffled by word, and adaptive execution splits hot
words. Only DataFrame functions are used.

Defined results: null text or text without words has no hit; an item without words has no window. An item with a null
identifier marks words but isn't counted or listed. Repeated items count once; repeated documents each give a row. A
table without documents gives no rows; an empty benchmark leaves all clean. Other columns aren't read, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, lower_ascii, saved

ITEM_WINDOW = 10
#: The windows' words, as text, up to which they are sent to every executor.
BROADCAST_BYTES = 32 << 20
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def marked_words(text: Column) -> Column:
    """An empty string, the words, and perhaps another empty string."""
    split = F.split(lower_ascii(text), _GAPS)
    return F.when(F.get(split, 0) == "", split).otherwise(F.concat(F.array(F.lit("")), split))


def _counted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    words = docs.select(F.col(f"`{id_col}`").alias("_id"), F.monotonically_increasing_id().alias("_row"), marked_words(F.col(f"`{text_col}`")).alias("_words"))
    last = F.element_at("_words", -1)
    return words.withColumn("_n", F.size("_words") - 1 - F.when((F.size("_words") > 1) & (last == ""), 1).otherwise(0))


def windows(items: DataFrame, size: int = ITEM_WINDOW) -> DataFrame:
    """_window, _w (its words) and _items, one row for each distinct window."""
    words = items.select(F.col("item_id").cast("string").alias("_item"), F.array_remove(marked_words(F.col("text")), "").alias("_all")).filter(F.size("_all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_all") - size + 1, F.lit(1)))
    each = words.select("_item", "_all", F.explode(starts).alias("_from")).select("_item", F.slice("_all", F.col("_from"), F.lit(size)).alias("_w"))
    return each.groupBy("_w").agg(F.collect_set("_item").alias("_items")).withColumn("_window", F.sha2(F.array_join("_w", " "), 256))


def with_prefix(found: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """found with _prefix, the rarest word of each window, and _at, its first place there."""
    places = found.select("_window", F.posexplode("_w").alias("_at", "_word"))
    known = places.select(F.col("_word").alias("_known")).distinct()
    vocabulary = F.broadcast(known) if _small(found) else known
    corpus = docs.select(F.explode(marked_words(F.col(f"`{text_col}`"))).alias("_word"))
    counts = corpus.join(vocabulary, F.col("_word") == F.col("_known"), "left_semi").groupBy("_word").agg(F.count(F.lit(1)).alias("_count"))
    ranked = places.join(counts, "_word").groupBy("_window").agg(F.min(F.struct("_count", "_word", "_at")).alias("_best"), F.count(F.lit(1)).alias("_present"))
    # a window with a word that the corpus lacks occurs nowhere
    joined = found.join(ranked, "_window").filter(F.col("_present") == F.size("_w"))
    return joined.select("_window", "_w", "_items", F.col("_best._word").alias("_prefix"), F.col("_best._at").alias("_at"))


def _small(stored: DataFrame) -> bool:
    """Whether the windows in stored are within the bound for a broadcast."""
    size = stored.agg(F.sum(F.octet_length(F.array_join("_w", " ")) + F.octet_length(F.array_join("_items", ",")) + 200)).first()[0] or 0
    return size <= BROADCAST_BYTES


def _fits(start: Column) -> Column:
    return (start >= 1) & (start + F.size("_w") - 1 <= F.col("_n"))


def _found_beside(prefixed: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_row, _id, _n, _spans (s, e) and _found (items) of each document, with the windows sent to every executor: words stay where they are."""
    start = F.col("_place") - F.col("_at")
    places = _counted(docs, id_col, text_col).select("_id", "_row", "_n", "_words", F.posexplode("_words").alias("_place", "_word"))
    joined = places.join(F.broadcast(prefixed), F.col("_word") == F.col("_prefix"), "left").filter((F.col("_place") == 0) | (_fits(start) & (F.slice("_words", F.greatest(start + 1, F.lit(1)), F.size("_w")) == F.col("_w"))))
    rows = joined.select("_id", "_row", "_n", F.when(F.col("_place") > 0, F.struct(start.alias("s"), (start + F.size("_w")).alias("e"))).alias("_span"), F.when(F.col("_place") > 0, F.col("_items")).alias("_items"))
    return rows.groupBy("_row").agg(F.max("_id").alias("_id"), F.max("_n").alias("_n"), F.array_sort(F.collect_set("_span")).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("_found"))


def _found_apart(prefixed: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The same with both sides shuffled by word: a word goes alone, with its row and place, and only places where a window fits come back to their document, once for each document."""
    words = saved(_counted(docs, id_col, text_col), "words")
    start = F.col("_place") - F.col("_at")
    places = words.select("_row", "_n", F.posexplode("_words").alias("_place", "_word")).filter("_place > 0")
    met = places.join(prefixed.select("_w", "_items", "_prefix", "_at"), F.col("_word") == F.col("_prefix")).filter(_fits(start))
    # stored, so that the joins on both sides of it can be split where a word is very frequent
    met = saved(met.select("_row", F.struct(start.alias("s"), "_w", "_items").alias("x")), "met")
    joined = words.join(met.groupBy("_row").agg(F.collect_list("x").alias("_x")), "_row", "left")
    hit = F.filter(F.coalesce("_x", F.expr("cast(array() AS array<struct<s: int, _w: array<string>, _items: array<string>>>)")), lambda x: F.slice("_words", x["s"] + 1, F.size(x["_w"])) == x["_w"])
    sure = joined.select("_row", "_id", "_n", hit.alias("_hit"))
    spans = F.transform("_hit", lambda x: F.struct(x["s"].alias("s"), (x["s"] + F.size(x["_w"])).alias("e")))
    return sure.select("_row", "_id", "_n", F.array_sort(F.array_distinct(spans)).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.transform("_hit", lambda x: x["_items"])))).alias("_found"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_words, n_hit, n_items, items_sha256, contaminated, spans (start and end word of each window found)."""
    found = saved(windows(items), "windows")
    prefixed = saved(with_prefix(found, docs, text_col), "prefixes")
    each = _found_beside(prefixed, docs, id_col, text_col) if _small(prefixed) else _found_apart(prefixed, docs, id_col, text_col)
    covered = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("e"), F.lit(0).alias("n")),
        lambda a, x: F.struct(F.greatest(a["e"], x["e"]).alias("e"), (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["e"], x["s"]))).alias("n")),
        lambda a: a["n"],
    )
    return each.select(
        F.col("_id").alias(id_col),
        F.col("_n").cast("long").alias("n_words"),
        covered.cast("long").alias("n_hit"),
        F.size("_found").cast("long").alias("n_items"),
        F.sha2(F.array_join("_found", ","), 256).alias("items_sha256"),
        (F.size("_spans") > 0).alias("contaminated"),
        F.transform("_spans", lambda x: F.struct((x["s"] - 1).alias("start"), (x["e"] - 1).alias("end"))).alias("spans"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that share no window with an item, with all their columns. Rows are told by the digest of the text, since identifiers may be null or repeated."""
    own, there = fresh(docs, "_mark"), fresh(docs, "_bad")
    marked = docs.withColumn(own, F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), 256))
    bad = contamination(marked, items, own, text_col).filter("contaminated").select(F.col(own).alias(there)).distinct()
    return marked.join(bad, F.col(own) == F.col(there), "left_anti").drop(own)
