"""Document fingerprints by one-permutation MinHash (DataFrame functions only).

The set of five-word shingles of a text (A to Z in lower case) is hashed once. A hash falls into one of 251 bins, and each bin
keeps its least value. A bin without a hash takes the value of another one (optimal densification): bin i looks
at bins c_i + a_i t (mod 251) for t = 0, 1, ... until one holds a value, with a_i and c_i drawn per bin, so empty bins
borrow from bins of their own choice and every bin is reached. For texts of very few shingles the same bin is found from the
other side, as the one of least t among the bins that hold a value. Of each value the low four bits are stored, sixteen
bins in a long: 128 bytes a text.

The likeness of two fingerprints is the share of bins that agree, corrected for agreement by chance: (p - 1/16) / (1 - 1/16), cut to
0..1. Its standard error is at most 0.034, for sets of many shingles.

A fingerprint is one expression over one row; no shuffle, no rows per shingle. The next document in order of ids is found
by cutting the ids into ranges of about equal size (quantiles of ids, at most 10,000 of them), so that texts are shuffled once; the first
document of each range is sent to the range before as well.

Cases: a null text counts as an empty one. A text of fewer than five words is one shingle, of no words the empty shingle, so
texts without words have one fingerprint. Null ids come first. Rows of equal id are in order of a hash of their text; equal rows are documents of their own, each next to
the other. A single row is its own next. Other columns are not read; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perimeter.llm.common import LOWER, UPPER, words

SHINGLE = 5
#: Bins (a prime, so that every step through them reaches all) and stored bits of each.
BINS, BITS = 251, 4
#: From so many filled bins on, empty ones probe; below, filled ones are ranked.
PROBED = 20
#: Bits of a value below its bin.
_LOW = 48
_NONE = (1 << _LOW) - 1
_PER_LONG = 64 // BITS
_LONGS = -(-BINS // _PER_LONG)
#: Most ranges of ids, and characters of text that one should hold.
RANGES, RANGE_CHARS = 10_000, 64_000_000


def _draws() -> tuple[list[int], list[int], list[int]]:
    """a_i, c_i and the inverse of a_i for each bin, by a multiplicative rule."""
    mixed = [(i + 1) * 0x9E3779B97F4A7C15 % (1 << 64) for i in range(BINS)]
    steps = [1 + (m >> 40) % (BINS - 1) for m in mixed]
    return steps, [(m >> 8) % BINS for m in mixed], [pow(a, -1, BINS) for a in steps]


def _whole(numbers: list[int]) -> Column:
    """The numbers as one constant."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<long>")


def shingle_hashes(text: Column) -> Column:
    """Hashes of the runs of five words; of the whole sequence where there are fewer."""
    def over(w: Column) -> Column:
        last = F.greatest(F.size(w) - SHINGLE, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + n) for n in range(SHINGLE)]))
    return _let(words(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)), over)


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bin(key: Column) -> Column:
    return F.shiftright(key, _LOW)


def _value(key: Column) -> Column:
    return key.bitwiseAND(F.lit(_NONE))


def _key(h: Column) -> Column:
    """Bin of a hash (from its upper sixteen bits) above its value (its lower bits)."""
    upper = F.shiftrightunsigned(h, 48)
    return F.shiftleft(F.shiftrightunsigned(upper * BINS, 16), _LOW) + h.bitwiseAND(F.lit(_NONE >> 1))


def least_per_bin(hashes: Column) -> Column:
    """The least key of each bin, in order of bins; one of value `_NONE` where a bin is empty."""
    first, last = _NONE, ((BINS - 1) << _LOW) + _NONE
    empty = F.sequence(F.lit(first), F.lit(last), F.lit(1 << _LOW))
    keys = F.array_sort(F.concat(F.transform(hashes, _key), empty))
    return _let(keys, lambda k: F.filter(k, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(k, i - 1)))))


def densified(bins: Column) -> Column:
    """One value per bin, borrowed where its own is missing."""
    a, c, inverse = map(_whole, _draws())
    missing = F.filter(bins, lambda x: _value(x) == _NONE)

    def ranked(held: Column) -> Column:
        def borrowed(x: Column) -> Column:
            turn = lambda y: F.pmod((_bin(y) - F.get(c, _bin(x).cast("int"))) * F.get(inverse, _bin(x).cast("int")), F.lit(BINS))
            return _value(F.array_min(F.transform(held, lambda y: F.shiftleft(turn(y), _LOW) + _value(y))))
        return F.transform(bins, lambda x: F.when(_value(x) == _NONE, borrowed(x)).otherwise(_value(x)))

    def probe(acc: Column, t: Column) -> Column:
        """One more look of every bin that is still open."""
        def found(x: Column) -> Column:
            b = _bin(x).cast("int")
            return _value(F.get(bins, ((F.get(c, b) + F.get(a, b) * t) % BINS).cast("int")))
        looked = F.transform(acc["open"], lambda x: x - _NONE + found(x))
        step = _let(looked, lambda y: F.struct(F.filter(y, lambda x: _value(x) == _NONE).alias("open"),
                                               F.concat(acc["done"], F.filter(y, lambda x: _value(x) != _NONE)).alias("done")))
        return F.when(F.size(acc["open"]) == 0, acc).otherwise(step)
    start = F.struct(missing.alias("open"), F.filter(bins, lambda x: _value(x) != _NONE).alias("done"))
    probed = F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")), start, probe,
                         lambda acc: F.transform(F.array_sort(acc["done"]), _value))
    held = F.filter(bins, lambda x: _value(x) != _NONE)
    return F.when(F.size(missing) > BINS - PROBED, _let(held, ranked)).otherwise(probed)


def packed(values: Column) -> Column:
    """Low bits of the values, sixteen to a long."""
    low = F.lit((1 << BITS) - 1)
    one = lambda n: F.aggregate(F.slice(values, n * _PER_LONG + 1, F.lit(_PER_LONG)), F.lit(0).cast("long"),
                                lambda acc, x: F.shiftleft(acc, BITS) + x.bitwiseAND(low))
    return F.transform(F.sequence(F.lit(0), F.lit(_LONGS - 1)), one)


def fingerprint(text: Column) -> Column:
    """Sixteen longs."""
    return _let(least_per_bin(shingle_hashes(text)), lambda bins: _let(densified(bins), packed))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets of two fingerprints."""
    ones = F.lit(int("1" * (64 // BITS), 16))

    def differ(x: Column, y: Column) -> Column:
        """Number of stored values that are not equal."""
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(ones))
    apart = F.aggregate(F.zip_with(a, b, differ), F.lit(0), lambda acc, n: acc + n)
    chance = 1 / (1 << BITS)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - apart / BINS - chance) / (1 - chance)))


def hexed(print_: Column) -> Column:
    return F.array_join(F.transform(print_, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def _stepped(step: int, cuts: list[int]):
    """One step of a bisect over constants: on by `step` if the id is not below the cut there."""
    table = _whole(cuts)
    return lambda at: F.when((at + step <= len(cuts)) & (F.get(table, at + (step - 1)) <= F.col("doc_id")), at + step).otherwise(at)


def with_next(docs: DataFrame, derived: dict[str, Column], next_: str = "next") -> DataFrame:
    """doc_id, text and the derived columns (computed once a row) with a struct of text and these of the next row in order of doc_id; after
    the last comes the first."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    ranges = min(RANGES, max(1, chars // RANGE_CHARS))
    shares = [n / ranges for n in range(1, ranges)]
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, RANGES)).first()[0] or [])) if shares else []
    # Number of cuts at or below the id, by bisect over a constant.
    low = F.lit(0)
    for n in reversed(range(len(cuts).bit_length())):
        low = _let(low, _stepped(1 << n, cuts))
    order = F.struct(F.col("doc_id").isNotNull().alias("told"), "doc_id", F.xxhash64("text").alias("tie"))
    ranged = docs.withColumn("_range", F.when(F.col("doc_id").isNull(), 0).otherwise(low)).withColumn("_order", order)
    # One row per range: at most 10,000, so one task can put them in order and every task can hold them.
    heads = ranged.groupBy("_range").agg(F.min("_order").alias("_head"))
    every = Window.orderBy("_range")
    last = F.last("_range").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select(F.col("_range").alias("_own"), "_head", F.coalesce(F.lag("_range").over(every), last).alias("_to"))
    guests = (ranged.join(F.broadcast(heads), (F.col("_range") == F.col("_own")) & F.col("_order").eqNullSafe(F.col("_head")))
              .select("doc_id", "text", F.col("_to").alias("_range"), "_order", F.lit(True).alias("_guest")))
    rows = ranged.withColumn("_guest", F.lit(False)).unionByName(guests).withColumns(derived)
    near = Window.partitionBy("_range").orderBy("_guest", "_order")
    out = rows.withColumn(next_, F.lead(F.struct("text", *derived)).over(near))
    return out.filter("NOT _guest").select("doc_id", "text", *derived, next_)


def half_replaced(text: Column, other: Column) -> Column:
    """A text whose last half (rounded down) is replaced by as many characters of the other, or by all of it."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))
