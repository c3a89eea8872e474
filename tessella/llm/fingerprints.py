"""Document fingerprints: threshold-scaled sketches, with DataFrame functions only.

The sketch of a text is the set of its word shingles' 64-bit hashes that lie in the lowest
``FRACTION`` of the hash range. The threshold is the same for every text, so a sketch grows with
its text, the sketch of joined shingle sets is the union of sketches, and the share of one sketch
in another estimates containment however unequal the texts are.

A text of few shingles may have none below the threshold. A fingerprint therefore holds, beside the
sketch, all hashes of a text with at most ``FEW`` distinct shingles. These are compared only with
those of another such text, exactly; beside a longer text the sketches speak, and where the sketch
of the shorter is empty they can't, so its containment is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BREAKS, id_and_text

SHINGLE_WORDS, FRACTION, FEW = 5, 1 / 4, 32
#: Documents that one range of ids holds, about; quantiles of ids that cut them at most; and parts
#: that the room between two quantiles is cut into at most.
RANGE_ROWS, RANGES, PARTS = 64, 16_384, 64


def words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAKS), lambda w: w != "")


def with_fingerprint(df: DataFrame, text_col: str, out_col: str, width: int = SHINGLE_WORDS, fraction: float = FRACTION, few: int = FEW) -> DataFrame:
    """``df`` with the fingerprint of a text column: a struct of sketch (sorted array<bigint>) and
    whole (all distinct hashes, sorted, or null if there are more than ``few``). Fewer words than
    ``width`` are one shingle, no words none; a null text has a null fingerprint."""
    w, h = f"__{out_col}_words", f"__{out_col}_hashes"
    limit = -(1 << 63) + int(fraction * (1 << 64))
    shingle = lambda i: F.xxhash64(*(F.get(F.col(w), i + k) for k in range(width)))
    all_hashes = (
        F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), shingle))
        .when(F.size(w) > 0, F.array(F.xxhash64(w)))
        .otherwise(F.array().cast("array<bigint>"))
    )
    sketch = F.array_sort(F.filter(h, lambda x: x < F.lit(limit)))
    whole = F.when(F.size(h) <= few, F.array_sort(h))
    return (
        df.withColumn(w, words(F.col(text_col)))
        .withColumn(h, F.array_distinct(all_hashes))
        .withColumn(out_col, F.when(F.col(text_col).isNotNull(), F.struct(sketch.alias("sketch"), whole.alias("whole"))))
        .drop(w, h)
    )


def merge(a: Column, b: Column, few: int = FEW) -> Column:
    """The fingerprint of two texts' shingles together."""
    whole = F.array_sort(F.array_union(a["whole"], b["whole"]))
    return F.struct(F.array_sort(F.array_union(a["sketch"], b["sketch"])).alias("sketch"), F.when(F.size(whole) <= few, whole).alias("whole"))


def _by_whole(a: Column, b: Column, of) -> Column:
    """``of`` two exact sets where both texts have them, else of their sketches."""
    exact = a["whole"].isNotNull() & b["whole"].isNotNull()
    return F.when(exact, of(a["whole"], b["whole"])).otherwise(of(a["sketch"], b["sketch"]))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two fingerprints: exact for two texts of few shingles, else estimated from
    the sketches. Two texts without words are alike; of sketches that are both empty, of a text of
    few shingles and a longer one, nothing is known to agree, so they are unlike."""

    def of(x: Column, y: Column) -> Column:
        both = F.size(F.array_intersect(x, y))
        return both / (F.size(x) + F.size(y) - both)  # null for two empty sets

    nothing = F.when((F.size(a["whole"]) == 0) & (F.size(b["whole"]) == 0), 1.0)
    return F.coalesce(nothing, _by_whole(a, b, of), F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Share of the first text's shingles that the second has: exact for two texts of few shingles,
    else estimated; null where the first has no hash below the threshold and the second is a
    longer text. A text without words is contained in any."""

    def of(x: Column, y: Column) -> Column:
        return F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x))

    return F.when(F.size(a["whole"]) == 0, 1.0).otherwise(_by_whole(a, b, of))


def as_string(fingerprint: Column) -> Column:
    """16 lowercase hex digits for each hash of the sketch; for a text of few shingles a colon and
    those of all its hashes follow."""
    digits = lambda x: F.array_join(F.transform(x, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")
    return F.concat(digits(fingerprint["sketch"]), F.coalesce(F.concat(F.lit(":"), digits(fingerprint["whole"])), F.lit("")))


def _range_of(bounds: list[int], nulls: int, parts: int) -> Column:
    """The number of a row's range; ranges ascend in the order of rows: descending doc_id, nulls last,
    equal ids by ``__hash``.

    The distinct bounds cut the ids, found by bisection. Of a cut, the ids above its bound come first,
    in ``parts`` by their distance, then those equal to it, by hash in as many parts as the bound was
    a quantile; the rows without an id are cut by hash into ``nulls``."""
    times: dict[int, int] = {}
    for x in bounds:
        times[x] = times.get(x, 0) + 1
    low, n = sorted(times), len(times)
    array = lambda xs: f"cast(split('{','.join(map(str, xs))}', ',') as array<bigint>)" if xs else "cast(array() as array<bigint>)"
    held, often = array(low), array([times[x] for x in low])
    cut = f"""aggregate(sequence(1, {max(1, n.bit_length())}), named_struct('lo', 0, 'hi', {n}),
        (p, _) -> if(p.lo < p.hi, if({held}[(p.lo + p.hi) div 2] <= doc_id,
            named_struct('lo', cast((p.lo + p.hi) div 2 + 1 as int), 'hi', p.hi),
            named_struct('lo', p.lo, 'hi', cast((p.lo + p.hi) div 2 as int))), p), p -> p.lo)"""
    by_hash = lambda k: f"(shiftright(__hash, 33) + 1073741824) * ({k}) div 2147483648"
    at = f"transform(array({cut}), c -> named_struct('c', c, 'low', get({held}, c - 1), 'high', get({held}, c), 'n', get({often}, c - 1)))[0]"
    above = f"if(x.high is null or x.low is null, 0, cast(floor((cast(x.high as double) - doc_id) / (cast(x.high as double) - x.low) * {parts}) as bigint))"
    return F.expr(
        f"""if(doc_id is null, {(n + 1) << 20} + {by_hash(nulls)}, transform(array({at}), x ->
        cast({n} - x.c as bigint) * {1 << 20} + if(doc_id = x.low and x.n > 1, {parts + 1} + {by_hash("x.n")}, {above}))[0])"""
    )


def with_next(docs: DataFrame, prepare=lambda df: df) -> DataFrame:
    """The rows of ``prepare(docs)``, which adds columns to (doc_id, text), each with the struct
    ``next`` of the row after it, in descending doc_id (null ids last, equal ids by the text's hash and
    the text); after the last row comes the first. doc_id is an integer.

    No task orders all rows: ids are cut into ranges by their quantiles, and ids that hold many rows
    (nulls too) further by hash; each range is ordered on its own, and gets the first row of the
    range after it as a mark behind its last row. Only rows alike in id and text can't be cut apart;
    they stream through one task. Texts are shuffled once, and what ``prepare`` adds isn't.
    """
    known = docs.agg(F.count("doc_id").alias("n"), F.sum(F.col("doc_id").isNull().cast("bigint")).alias("nulls")).first()
    n, nulls = known["n"], known["nulls"] or 0
    ranges = max(1, min(RANGES, n // RANGE_ROWS))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, 100_000).alias("q")).first()["q"] if shares else []
    parts = max(1, min(PARTS, n // (ranges * 256 * RANGE_ROWS)))
    ranged = docs.withColumn("__hash", F.xxhash64("text"))
    ranged = ranged.withColumn("__range", _range_of(bounds or [], max(1, min(RANGES, nulls // RANGE_ROWS)), parts))
    heads = ranged.groupBy("__range").agg(F.max("doc_id").alias("__head"))
    in_order, all_of = Window.orderBy("__range"), Window.partitionBy()  # a row a range: RANGES * (PARTS + 2) at most
    heads = heads.withColumn("__before", F.coalesce(F.lag("__range").over(in_order), F.max("__range").over(all_of)))
    first = (F.col("__range") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("__head"))
    marks = ranged.join(F.broadcast(heads.withColumnRenamed("__range", "r")), first)
    own = Window.partitionBy("__before").orderBy("__hash", "text")
    marks = marks.withColumn("n", F.row_number().over(own)).where("n = 1")
    marks = marks.select(F.col("__before").alias("__range"), "__hash", *docs.columns, F.lit(1).alias("__mark"))
    order = ("__mark", F.desc_nulls_last("doc_id"), "__hash", "text")
    dealt = ranged.select("__range", "__hash", *docs.columns, F.lit(0).alias("__mark")).unionByName(marks)
    rows = prepare(dealt.repartition("__range").sortWithinPartitions("__range", *order))
    carried = [c for c in rows.columns if c not in ("__range", "__mark", "__hash")]
    at = Window.partitionBy("__range").orderBy(*order)
    return rows.withColumn("next", F.lead(F.struct(*carried)).over(at)).where("__mark = 0").drop("__range", "__mark", "__hash")


def edited(text: Column, other: Column) -> Column:
    """The last third of the code points (rounded down) replaced by as many, or all, of another text's first."""
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(other, F.lit(1), third))


def fingerprint_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, contained_edited, contained_next.

    The edited text has its last third replaced by the first code points of the next document.
    Null and empty texts have the empty fingerprint, and two of these are alike. Ids of other types
    than integers are ordered by their hash. Rows without a doc_id come last in the order, rows with
    equal ids are ordered by the text's hash and the text, repeated rows follow each other; an empty
    table gives an empty result, a single row is its own next; other columns are not looked at.
    Whole texts are read, of any length.
    """
    d = id_and_text(docs, id_col, text_col)
    integral = d.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    d = d.select(F.col("doc_id").alias("__id"), (F.col("doc_id").cast("bigint") if integral else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))).alias("doc_id"), "text")
    d = with_next(d, lambda x: with_fingerprint(x, "text", "own")).withColumn("doc_id", F.col("__id"))
    d = d.withColumn("edited", edited(F.col("text"), F.col("next.text")))
    d = with_fingerprint(d, "edited", "of_edited")
    a, b, c = F.col("own"), F.col("of_edited"), F.col("next.own")
    return d.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(a).alias("fingerprint"),
        as_string(b).alias("edited_fingerprint"),
        likeness(a, b).alias("near_edited"),
        likeness(a, c).alias("near_next"),
        containment(a, b).alias("contained_edited"),
        containment(a, c).alias("contained_next"),
    )
