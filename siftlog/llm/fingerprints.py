"""Operator 10: document fingerprints by winnowing, in DataFrame functions only.

A text is a row of units: its words, and for short texts also its characters; a long text gets them
too where it is compared with one that has nothing else. Every run of ``k`` units
is hashed; in each window of hashes the smallest is chosen, the rightmost of equal ones. Any run of
``window + k - 1`` units that two texts share leaves at least one common hash, and the kept positions
say where. A chosen hash and its position share one long, hash first and the position counted down,
so that the smallest long is the rightmost smallest hash.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Units: (k, window). Texts under BOTH words have characters, texts of SHORT words or more have words.
WORDS, CHARS, SHORT, BOTH = (5, 16), (4, 2), 32, 64
POSITIONS = 0xFFFFFF


def _grams(units: str, k: int) -> str:
    return (
        f"transform(slice({units}, 1, greatest(size({units}) - {k - 1}, least(size({units}), 1))), (x, i) -> "
        f"(xxhash64(slice({units}, i + 1, {k})) & {0x7FFFFFFFFF000000}L) | cast({POSITIONS} - (i & {POSITIONS}) as bigint))"
    )


def _chosen(grams: str, window: int) -> str:
    return (
        f"array_distinct(transform(slice({grams}, 1, greatest(size({grams}) - {window - 1}, least(size({grams}), 1))), "
        f"(x, i) -> array_min(slice({grams}, i + 1, {window}))))"
    )


def with_fingerprint(df: DataFrame, text: str, prefix: str = "fp") -> DataFrame:
    """Add ``{prefix}_w`` and ``{prefix}_c``: chosen longs over words and over characters, in order of position.

    The list of a kind that the text is too short or too long for is empty. Null counts as ''. Positions
    are kept modulo 2^24 units. One projection per step, so that no step is computed again inside a lambda.
    """
    w, c, gw, gc = f"{prefix}_words", f"{prefix}_chars", f"{prefix}_gw", f"{prefix}_gc"
    plain = f"lower(coalesce({text}, ''))"
    step = df.withColumn(w, F.expr(rf"filter(split({plain}, '\\s+'), x -> x <> '')"))
    step = step.withColumns(
        {
            c: F.expr(f"if(size({w}) < {BOTH} and length({text}) > 0, split({plain}, ''), cast(array() as array<string>))"),
            w: F.expr(f"if(size({w}) >= {SHORT}, {w}, cast(array() as array<string>))"),
        }
    )
    step = step.withColumns({gw: F.expr(_grams(w, WORDS[0])), gc: F.expr(_grams(c, CHARS[0]))})
    step = step.withColumns({f"{prefix}_w": F.expr(_chosen(gw, WORDS[1])), f"{prefix}_c": F.expr(_chosen(gc, CHARS[1]))})
    return step.drop(w, c, gw, gc)


def shown(prefix: str) -> Column:
    """``w`` or ``c`` and ``hash@position`` of each chosen gram."""
    part = lambda kind: (
        f"transform({prefix}_{kind}, v -> concat(lower(hex(shiftright(v, 24))), '@', {POSITIONS} - (v & {POSITIONS})))"
    )
    return F.expr(f"array_join(concat(array('w'), {part('w')}, array('c'), {part('c')}), ' ')")


def _with_characters(df: DataFrame, text: str, prefix: str, needed: str) -> DataFrame:
    """Add the characters' longs to ``{prefix}_c`` where ``needed`` holds and the text was too long to have them."""
    c, g = f"{prefix}_chars", f"{prefix}_gc"
    step = df.withColumn(c, F.expr(f"if(size({prefix}_c) = 0 and ({needed}) and length({text}) > 0, split(lower({text}), ''), cast(array() as array<string>))"))
    step = step.withColumn(g, F.expr(_grams(c, CHARS[0]))).withColumn(g, F.expr(_chosen(g, CHARS[1])))
    return step.withColumn(f"{prefix}_c", F.expr(f"if(size({g}) > 0, {g}, {prefix}_c)")).drop(c, g)


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of the hashes of two fingerprints, by words if both have them, else by characters.

    Where one text has words only and the other characters only, ``_with_characters`` comes first. Two
    empty fingerprints are alike (1), an empty one and another are not (0).
    """
    hashes = lambda x: f"array_distinct(transform({x}, v -> shiftright(v, 24)))"

    def of(kind):
        x, y = f"{a}_{kind}", f"{b}_{kind}"
        common = f"size(array_intersect({hashes(x)}, {hashes(y)}))"
        return f"try_divide(cast({common} as double), size({hashes(x)}) + size({hashes(y)}) - {common})"

    return F.expr(
        f"case when size({a}_w) + size({a}_c) + size({b}_w) + size({b}_c) = 0 then 1.0D "
        f"when size({a}_w) > 0 and size({b}_w) > 0 then {of('w')} "
        f"when size({a}_c) > 0 and size({b}_c) > 0 then {of('c')} else 0.0D end"
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every whole text. Equal texts have equal fingerprints; '' has an empty one."""
    found = with_fingerprint(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text")
    return found.select("doc_id", shown("fp").alias("fingerprint"))


#: Parts of one id's range are counted within this number.
PARTS = 65_536


def _literal(values: list, suffix: str = "L") -> str:
    return f"cast(array({', '.join(f'{v}{suffix}' for v in values)}) as array<{'double' if suffix == 'D' else 'bigint'}>)"


def _with_bucket(docs: DataFrame, rows_per_bucket: int, max_buckets: int) -> DataFrame:
    """Add ``tie``, a hash of the text, and ``bucket``: ranges of about equal numbers of rows, falling in the order of rows.

    Ranges end at quantiles of the ids, which one aggregation of bounded size estimates, so neither a
    few outlying ids nor gaps matter. An id that fills several ranges, or a null id, gets a range for
    itself, cut into parts by equal ranges of ``tie``.
    """
    docs = docs.withColumn("tie", F.xxhash64("text"))
    total = docs.agg(F.count("*"), F.expr("count_if(doc_id is null)")).first()
    buckets = max(1, min(max_buckets, -(-total[0] // rows_per_bucket)))
    shares = F.expr(_literal([i / buckets for i in range(1, buckets + 1)], "D"))
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("bigint"), shares, max(10_000, 4 * buckets))).first()[0] or []
    repeats = {c: min(PARTS, n) for c, n in Counter(cuts).items() if n > 1}
    cuts = sorted(set(cuts) | {c - 1 for c in repeats if c > -(2**63)})
    side = max(1, math.isqrt(len(cuts)))
    blocks = [cuts[i : i + side] for i in range(0, len(cuts), side)]
    # the number of cuts below an id: first the blocks that end below it, then inside the next block
    block = f"size(filter({_literal([x[-1] for x in blocks])}, c -> c < doc_id))"
    inside = f"size(filter(coalesce(get(array({', '.join(map(_literal, blocks))}), _block), {_literal([])}), c -> c < doc_id))" if blocks else "0"
    parts = F.lit(min(PARTS, max(1, -(-total[1] // rows_per_bucket))))
    many = F.expr(f"coalesce(try_element_at(map_from_arrays({_literal([*repeats])}, {_literal([*repeats.values()])}), cast(doc_id as bigint)), 1L)") if repeats else F.lit(1)
    parts = F.when(F.col("doc_id").isNull(), parts).otherwise(many)
    part = F.expr(f"cast((shiftright(tie, 32) + {2**31}L) * _parts div {2**32}L as int)")
    out = docs.withColumn("_block", F.expr(block)).withColumns({"_parts": parts, "_range": F.expr(f"if(doc_id is null, -1L, _block * {side}L + {inside})")})
    return out.withColumn("bucket", F.col("_range") * PARTS + (PARTS - 1 - part)).drop("_block", "_parts", "_range")


def edited_neighbours(docs: DataFrame, rows_per_bucket: int = 1000, max_buckets: int = 16_000) -> DataFrame:
    """Fingerprint every text, its edited text, and compare both and the next document's.

    Next is the document with the next smaller ``doc_id``, after the last the first; equal ids follow in
    the order of hashes of their texts and null ids come last. The edited text replaces the last floor(n / 2) code
    points by as many from the start of the next text. Null texts are ''. One row per row; other columns
    are ignored; a single row is its own next; an empty table gives no rows.

    Neighbours are found in ranges of ids (``_with_bucket``), so texts are shuffled once and evenly whatever their source or
    ids; only rows with one id and one text can't be told apart and stay together. The top row of a range meets the last row
    of the range before by a join on the range. The list of ranges that one task orders has at most about ``2 * max_buckets`` rows
    and those of null ids.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranged = _with_bucket(docs, rows_per_bucket, max_buckets)
    first = ranged.groupBy("bucket").agg(F.max("doc_id").alias("top"))
    first = first.select("bucket", "top", F.coalesce(F.lead("bucket").over(Window.orderBy(F.desc("bucket"))), F.max("bucket").over(Window.partitionBy())).alias("after"))
    tops = ranged.alias("d").join(F.broadcast(first.alias("t")), F.expr("d.bucket = t.bucket and d.doc_id <=> t.top"), "left_semi")
    tops = tops.groupBy("bucket").agg(F.min(F.struct("tie", "text")).alias("row")).select("bucket", F.col("row.text").alias("top_text"))
    tops = tops.join(F.broadcast(first.select(F.col("bucket").alias("of"), F.col("after").alias("bucket"))), "bucket")
    tops = with_fingerprint(tops.select(F.col("of").alias("bucket"), "top_text"), "top_text", "top")
    order = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), "tie", "text")
    own = with_fingerprint(ranged, "text", "own").withColumn("row", F.struct("text", "own_w", "own_c"))
    pairs = own.withColumn("next", F.lead("row").over(order)).drop("row").join(tops, "bucket")
    pairs = pairs.select(
        "doc_id", "text", "own_w", "own_c",
        F.expr("if(next is null, top_text, next.text)").alias("next_text"),
        F.expr("if(next is null, top_w, next.own_w)").alias("next_w"),
        F.expr("if(next is null, top_c, next.own_c)").alias("next_c"),
    )
    pairs = pairs.withColumn("n_chars", F.length("text").cast("bigint")).withColumn(
        "edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(next_text, 1, cast(n_chars div 2 as int)))")
    )
    pairs = with_fingerprint(pairs, "edited", "edited")
    pairs = pairs.withColumns({"fingerprint": shown("own"), "edited_fingerprint": shown("edited")})
    # A text of words only meets one of characters only: compare them by characters.
    lone = lambda x: f"size({x}_w) = 0 and size({x}_c) > 0"
    pairs = pairs.withColumns({f"{x}_lone": F.expr(lone(x)) for x in ("own", "edited", "next")})
    pairs = _with_characters(pairs, "text", "own", "edited_lone or next_lone")
    pairs = _with_characters(pairs, "edited", "edited", "own_lone")
    pairs = _with_characters(pairs, "next_text", "next", "own_lone")
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness("own", "edited").alias("near_edited"),
        likeness("own", "next").alias("near_next"),
    )
