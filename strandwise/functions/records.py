"""Column expressions over alignment records: flags, CIGAR, strings, qualities, arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bits of the record flag.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, SECOND, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = (1 << i for i in range(12))


def has(bit: int, flags: str = "flags") -> Column:
    return F.col(flags).bitwiseAND(F.lit(bit)) != 0


def bits(on: int, off: int, flags: str = "flags") -> Column:
    """Whether all bits of ``on`` are set and none of ``off``, in one test."""
    return F.col(flags).bitwiseAND(F.lit(on | off)) == F.lit(on)


def primary(flags: str = "flags") -> Column:
    return F.col(flags).bitwiseAND(F.lit(SECONDARY | SUPPLEMENTARY)) == 0


def cigar_ops(cigar: str = "cigar") -> Column:
    """A CIGAR string as an array of (len, op); ``*`` and the empty string are no operators."""
    return F.expr(f"transform(regexp_extract_all({cigar}, '([0-9]+)([MIDNSHP=X])', 0), e -> named_struct('len', cast(substr(e, 1, length(e) - 1) as int), 'op', substr(e, -1)))")


def _total(ops: str, kinds: str) -> Column:
    chosen = ", ".join(f"'{k}'" for k in kinds)
    return F.expr(f"aggregate({ops}, 0, (n, e) -> n + if(e.op in ({chosen}), e.len, 0))")


def reference_length(ops: str = "ops") -> Column:
    return _total(ops, "MDN=X")


def read_length(ops: str = "ops") -> Column:
    return _total(ops, "MIS=X")


def aligned_length(ops: str = "ops") -> Column:
    return _total(ops, "M=X")


def op_total(kinds: str, ops: str = "ops") -> Column:
    return _total(ops, kinds)


def leading(kinds: str, ops: str = "ops") -> Column:
    """Length of the run of the given operators at the start."""
    chosen = ", ".join(f"'{k}'" for k in kinds)
    return F.expr(f"aggregate({ops}, named_struct('n', 0, 'on', true), (s, e) -> named_struct('n', s.n + if(s.on and e.op in ({chosen}), e.len, 0), 'on', s.on and e.op in ({chosen})), s -> s.n)")


def trailing(kinds: str, ops: str = "ops") -> Column:
    return leading(kinds, f"reverse({ops})")


def unclipped_start(pos: str = "pos", ops: str = "ops") -> Column:
    return F.col(pos) - leading("SH", ops)


def alignment_end(pos: str = "pos", ops: str = "ops") -> Column:
    return F.col(pos) + reference_length(ops) - 1


def unclipped_end(pos: str = "pos", ops: str = "ops") -> Column:
    return alignment_end(pos, ops) + trailing("SH", ops)


def five_prime(ops: str = "ops") -> Column:
    """The unclipped 5' coordinate: the end of a reverse read, the start of a forward one."""
    return F.when(has(REVERSE), unclipped_end("pos", ops)).otherwise(unclipped_start("pos", ops))


def blocks(pos: str = "pos", ops: str = "ops") -> Column:
    """Aligned runs as (read_start, ref_start, len): 0-based in the read, 1-based on the reference."""
    return F.expr(
        f"aggregate({ops}, named_struct('r', 0, 'p', {pos}, 'b', cast(array() as array<struct<read_start:int,ref_start:int,len:int>>)), "
        "(s, e) -> named_struct('r', s.r + if(e.op in ('M', '=', 'X', 'I', 'S'), e.len, 0), 'p', s.p + if(e.op in ('M', '=', 'X', 'D', 'N'), e.len, 0), "
        "'b', if(e.op in ('M', '=', 'X'), concat(s.b, array(named_struct('read_start', s.r, 'ref_start', s.p, 'len', e.len))), s.b)), s -> s.b)"
    )


def reverse_complement(x: Column | str) -> Column:
    return F.translate(F.reverse(x), "ACGTacgt", "TGCAtgca")


def complement(x: Column | str) -> Column:
    return F.translate(x, "ACGTacgt", "TGCAtgca")


def hamming(a: str, b: str) -> Column:
    """Differing characters of two strings of equal length; null if their lengths differ."""
    return F.expr(f"if(length({a}) = length({b}), aggregate(if({a} = '', cast(array() as array<int>), sequence(1, length({a}))), 0, (n, i) -> n + if(substr({a}, i, 1) <> substr({b}, i, 1), 1, 0)), null)")


def half_up(x: Column) -> Column:
    """Rounding to the next integer, halves upwards (for negative numbers too)."""
    return F.floor(x + F.lit(0.5))


def guarded(a: Column, b: Column) -> Column:
    """a / b; 0 where the divisor is at most a millionth in size."""
    return F.when(F.abs(b) <= 1e-6, F.lit(0.0)).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where the divisor is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def rounded(x: Column, digits: int = 6) -> Column:
    """To ``digits`` decimals, as the checking SQL does it."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def error_rate(quality: Column) -> Column:
    return F.pow(F.lit(10.0), -quality / F.lit(10.0))


def phred(p: Column) -> Column:
    """Rounded phred score of an error probability; probability 0 gives -1."""
    return F.when(p <= 0, F.lit(-1)).otherwise(half_up(-10 * F.log10(p)).cast("int"))


def bayesian_quality(errors: Column, total: Column, prior_quality: float = 30.0) -> Column:
    """Phred score of (errors + prior) / (total + 1)."""
    return half_up(-10 * F.log10((errors + F.lit(10 ** (-prior_quality / 10))) / (total + 1))).cast("int")


def count_true(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def sum_if(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("long")


def location(name: str = "name") -> Column:
    """(tile, x, y) of a read name: the last three of exactly 5 or 7 fields between colons, leading digits of each; else null."""
    part = lambda i: f"cast(nullif(regexp_extract(element_at(split({name}, ':'), {i}), '^-?[0-9]+', 0), '') as int)"
    return F.expr(f"if(size(split({name}, ':')) in (5, 7), named_struct('tile', {part(-3)}, 'x', {part(-2)}, 'y', {part(-1)}), null)")


def quality_trim_point(quals: str, threshold: int) -> Column:
    """How many leading bases stay when the end is trimmed where the running sum of (threshold - quality) from the end is largest."""
    step = f"s.sum + {threshold} - element_at({quals}, i)"
    return F.expr(
        f"if(size({quals}) = 0, 0, aggregate(sequence(size({quals}), 1, -1), named_struct('sum', 0, 'best', 0, 'at', size({quals}), 'on', true), "
        f"(s, i) -> named_struct('sum', {step}, 'best', if(s.on and {step} > s.best, {step}, s.best), 'at', if(s.on and {step} > s.best, i - 1, s.at), 'on', s.on and {step} >= 0), s -> s.at))"
    )


def phred_text(quals: str) -> Column:
    """An array of qualities as text, offset 33."""
    return F.expr(f"array_join(transform({quals}, q -> char(q + 33)), '')")


def phred_values(text: str) -> Column:
    return F.expr(f"transform(filter(split({text}, ''), c -> c <> ''), c -> ascii(c) - 33)")
