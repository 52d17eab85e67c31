"""Operator 5: document fingerprints by Order MinHash, with DataFrame functions only.

The k-mers are runs of ``K`` words, or of characters where words are very long. Each gets the number of its occurrence in the text, so that repeats count, and a
64-bit hash of both. The hash's top bits name one of ``BUCKETS`` sketches; each sketch selects its ``L`` minimal k-mers,
puts them back into their order in the text and hashes that tuple to a signature. A sketch that was dealt fewer than ``L``
selects from all k-mers of the text instead, by a hash of its own, so that the order tells in short texts too. Two texts' likeness is the share of
sketches, of those that either fills, whose signatures are equal: it falls with edits that change k-mers and with edits
that move them. All steps stay inside one row and one pass over its words: no k-mer is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bounded_sample, free_name, let, stage

K, L, BUCKET_BITS = 3, 2, 6
BUCKETS = 1 << BUCKET_BITS
#: Documents are put into ranges of doc_id of about this many, inside which the next document is found.
ROWS_PER_RANGE = 4096
#: A step has at most so many ranges, so that the table of ranges that is broadcast has at most 256 times as many rows.
MOST_PER_STEP = 4096
#: The bound of the sample of ids that are not whole numbers, from which their 256 steps are cut.
SAMPLE = 16_384
#: What k-mers consist of: words of up to 24 characters; of longer words, as where no white space is written, each
#: character down to the last 24.
UNIT = WORD.removesuffix("+") + "{1,24}(?!" + WORD.removesuffix("+") + ")|" + WORD.removesuffix("+")


def signatures(text: Column) -> Column:
    """BUCKETS signatures of 32 bits of a whole text, all null if it has no units. A text of under K units is one k-mer; one
    of under L k-mers makes shorter tuples."""
    words = F.transform(F.regexp_extract_all(text, F.lit(f"({UNIT})"), F.lit(1)), lambda w: F.xxhash64(w))
    return let(words, _of_words)


def _of_words(words: Column) -> Column:
    last = F.greatest(F.size(words) - K, F.lit(0))
    kmer = lambda i: F.struct(F.xxhash64(*(F.get(words, i + j) for j in range(K))).alias("h"), i.alias("at"))
    ordered = F.sort_array(F.transform(F.sequence(F.lit(0), last), kmer))
    return F.when(F.size(words) > 0, let(ordered, _of_sorted)).otherwise(F.array_repeat(F.lit(None).cast("long"), BUCKETS))


def _of_sorted(kmers: Column) -> Column:
    """``kmers``: hash and position, sorted; equal ones stand together in the order of the text."""
    end = F.size(kmers)
    same = lambda i: F.get(kmers, i)["h"]
    starts = F.filter(F.sequence(F.lit(0), end - 1), lambda i: (i == 0) | (same(i) != same(i - 1)))

    def numbered(starts: Column) -> Column:
        runs = F.transform(
            starts,
            lambda s, r: F.transform(
                F.sequence(s, F.coalesce(F.get(starts, r + 1), end) - 1),
                lambda i: F.struct(F.xxhash64(same(i), i - s).alias("h"), F.get(kmers, i)["at"].alias("at")),
            ),
        )
        return let(F.sort_array(F.flatten(runs)), selected)

    def selected(hashed: Column) -> Column:
        bucket = lambda e: F.shiftrightunsigned(e["h"], 64 - BUCKET_BITS)
        # sorted by hash, a sketch's k-mers stand together: its L least are those with no other of it L places before
        least = F.filter(hashed, lambda e, i: (i < L) | F.coalesce(bucket(F.get(hashed, i - L)) != bucket(e), F.lit(True)))
        dealt = F.transform(least, lambda e: F.struct(bucket(e).alias("b"), e["at"].alias("at"), e["h"].alias("h")))

        def of_all(b: Column) -> Column:
            own = F.sort_array(F.transform(hashed, lambda e: F.struct(F.xxhash64(e["h"], b).alias("own"), e["at"].alias("at"), e["h"].alias("h"))))
            return F.transform(F.slice(own, 1, L), lambda e: F.struct(b.cast("long").alias("b"), e["at"].alias("at"), e["h"].alias("h")))

        def one(t: Column, bs: Column, b: Column) -> Column:
            at = F.array_position(bs, b.cast("long")).cast("int")
            full = (at > 0) & F.coalesce(F.get(bs, at - 2 + L) == b, F.lit(False))
            return _signature(F.when(full, F.slice(t, F.greatest(at, F.lit(1)), F.lit(L))).otherwise(of_all(b)))

        return let(dealt, lambda t: let(F.transform(t, lambda e: e["b"]), lambda bs: F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: one(t, bs, b))))

    return let(starts, numbered)


def _signature(chosen: Column) -> Column:
    """The hash of up to L k-mers in the order of the text."""
    return let(F.sort_array(F.transform(chosen, lambda e: F.struct(e["at"].alias("at"), e["h"].alias("h")))), lambda c: F.shiftrightunsigned(F.xxhash64(*(F.get(c, F.lit(j))["h"] for j in range(L))), 32))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal signatures among the sketches that either fills; 1 if neither fills any, 0 without a partner."""
    pairs = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), F.lit(None)).otherwise(x.eqNullSafe(y)))
    filled = F.filter(pairs, lambda p: p.isNotNull())
    share = let(filled, lambda f: F.when(F.size(f) == 0, 1.0).otherwise(F.size(F.filter(f, lambda p: p)).cast("double") / F.size(f)))
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(share)


def as_string(sig: Column) -> Column:
    """The fingerprint in print: all signatures in full, 8 hex digits each, so likeness can be computed from it."""
    return F.array_join(F.transform(sig, lambda s: F.when(s.isNull(), "--------").otherwise(F.lower(F.lpad(F.hex(s), 8, "0")))), "")


def ranges(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> tuple[Column, DataFrame]:
    """An expression for the range of a doc_id, later ranges holding smaller ids and the last one null, and the table
    (lead, before): the greatest id of each range and the range that ends just before it, going round at the end.

    Ranges are of equal width inside at most 256 steps of about equal numbers of rows, so ids may be spread unevenly. Ids
    that are not whole numbers have steps only.
    """
    if docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        number = _numeric_range(docs, rows_per_range)
    else:
        n = docs.count()
        found = bounded_sample(docs.select("doc_id", F.xxhash64("doc_id").alias("draw")).filter("doc_id is not null"), n, "draw", SAMPLE)
        ids = sorted({r[0] for r in found.collect()})
        keep = min(256, max(1, -(-n // rows_per_range)))
        cuts = [F.lit(ids[i * len(ids) // keep]) for i in range(keep)] if ids else []
        step = F.size(F.filter(F.array(*cuts), lambda c: c <= F.col("doc_id"))) + 1 if cuts else F.lit(1)
        number = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(step).cast("long")
    leads = docs.select("doc_id", number.alias("range")).groupBy("range").agg(F.max("doc_id").alias("lead"))
    order = Window.orderBy(F.col("range").desc())  # a row for each range
    around = F.coalesce(F.lag("range").over(order), F.first("range").over(Window.orderBy("range")))
    return number, stage(leads.select("range", "lead", around.alias("before")), "ranges")


def _numeric_range(docs: DataFrame, rows_per_range: int) -> Column:
    n, low, high, cuts = docs.agg(F.count("doc_id"), F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", [i / 256 for i in range(1, 256)], 2000)).first()
    low, high = low or 0, high or 0
    per = min(MOST_PER_STEP, max(1, -(-n // (rows_per_range * 256))))
    cuts = sorted({low, *(cuts or [])})
    if n <= rows_per_range * 256:
        keep = max(1, -(-n // rows_per_range))
        cuts = sorted({low, *(cuts[i * len(cuts) // keep] for i in range(keep))})
    bounds = F.array(*(F.lit(int(c)).cast("long") for c in [*cuts, high + 1]))
    step = F.size(F.filter(F.array(*(F.lit(int(c)).cast("long") for c in cuts)), lambda c: c <= F.col("doc_id")))
    lo, hi = F.element_at(bounds, step), F.element_at(bounds, step + 1)
    inside = F.floor((F.col("doc_id") - lo).cast("double") * per / (hi - lo)) if per > 1 else F.lit(0)
    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise((step * per + F.least(inside, F.lit(per - 1))).cast("long")).cast("long")


def with_next(docs: DataFrame, carried: list[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``docs`` with next_<column> of the next document by descending doc_id, null last; after the last comes the first.

    Rows are dealt once, by their range of ids; the leader of a range is dealt to the range before as well, where it
    only serves as the last row's next. Rows of one id are ordered by their text's hash.
    """
    number, leads = ranges(docs, rows_per_range)
    at, lead, before, guest, tie = (free_name(docs, x) for x in ("range", "lead", "before", "guest", "tie"))
    few = F.broadcast(leads.select(F.col("lead").alias(lead), F.col("range").alias(f"{lead}_range"), F.col("before").alias(before)))
    rows = docs.withColumn(at, number).withColumn(tie, F.xxhash64("text"))
    rows = rows.join(few, (F.col(at) == F.col(f"{lead}_range")) & F.col("doc_id").eqNullSafe(F.col(lead)), "left")
    own = F.struct(F.col(at).alias("r"), F.lit(False).alias("g"))
    rows = rows.withColumn(guest, F.explode(F.when(F.col(before).isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col(before).alias("r"), F.lit(True).alias("g"))))))
    order = Window.partitionBy(f"{guest}.r").orderBy(F.col(f"{guest}.g"), F.col("doc_id").desc_nulls_last(), tie)
    rows = rows.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in carried))
    return rows.filter(~F.col(f"{guest}.g")).drop(at, lead, f"{lead}_range", before, guest, tie)


def edited(text: Column, following: Column) -> Column:
    """The last half of a text's code points replaced by the first as many, or all, of the following text."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - half), F.substr(following, F.lit(1), half))


def fingerprinted(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of
    ``docs`` (doc_id, text).

    Null texts count as empty; wordless texts fill no sketch, print only dashes and are alike; repeated rows are each
    other's next, those of one id in the order of their text's hash; a single document is its own next; null ids stand
    last; an empty table gives no rows; other columns are not looked at. Very long texts are fingerprinted whole, inside
    one row, in memory that follows the text. All rows of one id stand in one range.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("sig", signatures(F.col("text")))
    rows = with_next(rows, ["text", "sig"], rows_per_range)
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited(F.col("text"), F.col("next_text")).alias("edited"), "sig", "next_sig")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sig", "next_sig", signatures(F.col("edited")).alias("edited_sig"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string(F.col("sig")).alias("fingerprint"),
        as_string(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
