"""Column expressions over names, texts and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sequence-file suffixes that a sample name loses, case-sensitive.
SEQUENCE_SUFFIX = r"[.](fa|fasta|fna)([.]gz)?$"


def stripped(value: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def sample_name(path: Column) -> Column:
    """Canonical sample name of a path: the base name without its sequence suffix, or else without its last extension.

    Leading-dot names keep their dot; `.fa` gives an empty name; a dot at the end goes.
    """
    base = F.regexp_extract(stripped(path), r"([^/]*)/*$", 1)
    return F.when(base.rlike(SEQUENCE_SUFFIX), F.regexp_replace(base, SEQUENCE_SUFFIX, "")).otherwise(F.regexp_replace(base, r"^(.+)[.][^.]*$", "$1"))


def is_entry(line: Column) -> Column:
    """True for manifest lines that name a sample: neither blank nor a comment."""
    return (stripped(line) != "") & ~stripped(line).startswith("#")


def kmers(length: Column, k: int) -> Column:
    """k-mers of a sequence; a sequence shorter than k counts as one."""
    return F.greatest(length - k, F.lit(0)) + 1


def minimizer_size(k: Column) -> Column:
    return F.least(F.lit(20), k - 2)


def dense(size: Column, n: Column) -> Column:
    """True for sets for which pairs across the border are fewer than pairs inside; ties are False."""
    return size * (n - size) < size * (size - 1) / 2


def half_even(value: Column) -> Column:
    """Nearest integer, halves to the even one."""
    return F.rint(value)


def kilobytes(value: Column, unit: Column) -> Column:
    """Memory in kB of 1000 bytes, from bytes or from KiB."""
    return F.rint(F.when(unit == "bytes", value / 1000).otherwise(value * 1024 / 1000)).cast("long")


def cpu_percent(cpu_s: Column, real_s: Column) -> Column:
    """Share of the wall time in percent; null where the wall time is not positive."""
    return F.when(real_s > 0, 100.0 * cpu_s / real_s)


def percent_text(value: Column) -> Column:
    return F.concat(F.format_string("%.1f", value), F.lit("%"))


def exit_code(code: Column) -> Column:
    """Exit codes as a shell tells them: a signal n is 128 + n."""
    return F.when(code < 0, 128 - code).otherwise(code)


def run_status(code: Column, timed_out: Column, timed: Column) -> Column:
    """timeout, timing_error, ok or failed, in this order of precedence."""
    return F.when(timed_out, "timeout").when(~timed, "timing_error").when(code == 0, "ok").otherwise("failed")


def run_key(path: Column, types: tuple[str, ...] = ("kmer", "unitig", "uniqrow"), methods: tuple[str, ...] = ("optimal", "worst", "nj", "upgma", "randomized")) -> Column:
    """Struct (dataset, method, k, n, type) of a runs file's path.

    A path of another form, or with a method or weighting that isn't known, raises an error.
    """
    form = rf"^(?:.*/)?(.+)_({'|'.join(methods)})_k(\d+)_N(\d+)_({'|'.join(types)})[.]runs$"
    part = lambda i: F.regexp_extract(path, form, i)
    checked = F.when(path.rlike(form), part(1)).otherwise(F.raise_error(F.concat(F.lit("not a runs file: "), path)).cast("string"))
    return F.struct(checked.alias("dataset"), part(2).alias("method"), part(3).cast("int").alias("k"), part(4).cast("int").alias("n"), part(5).alias("type"))


def leaves(newick: Column) -> Column:
    """Leaf names of a Newick tree from left to right.

    The text is parted at commas; of each part, what follows its last opening bracket and stands before a colon is a leaf.
    A tree without a leaf, or with one called like the join of trees, raises an error.
    """
    pieces = F.transform(F.split(newick, ","), lambda x: F.substring_index(F.split_part(x, F.lit(")"), F.lit(1)), "(", -1))
    found = F.transform(F.filter(pieces, lambda x: x.contains(":")), lambda x: stripped(F.split_part(x, F.lit(":"), F.lit(1))))
    named = F.filter(found, lambda x: x != "")
    sound = (F.size(named) > 0) & ~F.array_contains(named, "merge_root")
    return F.when(sound, named).otherwise(F.raise_error(F.concat(F.lit("no leaves, or a leaf named merge_root: "), F.left(newick, F.lit(80)))).cast("array<string>"))
