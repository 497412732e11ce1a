"""Column expressions over residue strings. All stay on the JVM; none needs a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RESIDUES = "ACDEFGHIKLMNPQRSTVWY"  # fixed value: the 20 canonical letters
MOTIF = "R[A-Z]{4}H"  # fixed value: the motif of two catalytic residues
MOTIF_LENGTH = 6
KEYWORDS = ("Cas13", "cas13", "C2c2", "c2c2")  # fixed value: case counts


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """Null as the empty string."""
    return F.coalesce(col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """Without leading and trailing white space of any kind (trim removes blanks only)."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def clean(c: Column | str, letters: str = RESIDUES) -> Column:
    """Upper-case and keep only the given letters; null gives the empty string."""
    return F.regexp_replace(F.upper(text(c)), f"[^{letters}]", "")


def clean_with_x(c: Column | str) -> Column:
    """Like clean, but X (any residue) stays."""
    return clean(c, RESIDUES + "X")


def changed_by_cleaning(raw: Column | str) -> Column:
    """Did cleaning remove anything besides blanks, tabs and line ends?"""
    return clean(raw) != F.translate(F.upper(text(raw)), " \n\r\t", "")


def content_hash(c: Column | str) -> Column:
    return F.sha2(col(c), 256)


def cache_key(seq: Column | str, scorer: str, version: str, config_hash: str) -> Column:
    """Key of one score: sequence hash, scorer, version and configuration."""
    return F.sha2(F.concat_ws("|", content_hash(seq), F.lit(scorer), F.lit(version), F.lit(config_hash)), 256)


def letters(c: Column) -> Column:
    """The characters as an array; empty for the empty string."""
    return F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))


def is_canonical(c: Column | str) -> Column:
    """True also for the empty string."""
    return text(c).rlike(f"^[{RESIDUES}]*$")


def invalid_letters(c: Column) -> Column:
    """The distinct letters outside the alphabet, sorted, as one string."""
    return F.array_join(F.array_sort(F.array_distinct(letters(F.regexp_replace(c, f"[{RESIDUES}]", "")))), "")


def motif_count(c: Column | str) -> Column:
    return F.regexp_count(F.upper(text(c)), F.lit(MOTIF))


def motif_positions(c: Column) -> Column:
    """0-based starts of the motifs, which don't overlap: what lies between them is measured."""
    gaps = F.transform(F.split(c, MOTIF, -1), F.length)
    n = F.size(gaps) - 1
    at = lambda i: F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda a, x: a + x) + i * MOTIF_LENGTH
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), at)).otherwise(F.array().cast("array<int>"))


def motif_score(count: Column) -> Column:
    """Two or more: 1; one: 0.5; none: 0."""
    return F.when(count >= 2, 1.0).when(count == 1, 0.5).otherwise(0.0)


def motif_position_score(count: Column) -> Column:
    """Exactly two: 1; one: -0.5; any other number: -1."""
    return F.when(count == 2, 1.0).when(count == 1, -0.5).otherwise(-1.0)


def max_run(c: Column) -> Column:
    """Length of the longest run of one character; 0 for the empty string."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit(r"(?s)(.)\1*"), F.lit(0)), F.length)), F.lit(0))


def max_fraction(c: Column) -> Column:
    """Share of the most frequent character; 0 for the empty string."""
    counts = F.transform(F.array_distinct(letters(c)), lambda x: F.length(c) - F.length(F.replace(c, x, F.lit(""))))
    return F.when(F.length(c) > 0, F.array_max(counts) / F.length(c)).otherwise(0.0)


def letter_count(c: Column, which: str) -> Column:
    """How many characters are one of which."""
    return F.length(c) - F.length(F.translate(c, which, ""))


def validity_score(c: Column | str, lo: int = 200, hi: int = 1500) -> Column:
    """0 with any letter outside the alphabet; 1 within the length range; falling linearly outside it."""
    s = F.upper(text(c))
    n = F.length(s)
    return (
        F.when(~is_canonical(s), 0.0).when(n.between(lo, hi), 1.0).when(n == 0, 0.0)
        .when(n < lo, n / F.lit(float(lo))).otherwise(F.greatest(F.lit(0.0), 1 - (n - hi) / F.lit(float(hi))))
    )


def features(c: Column | str) -> Column:
    """24 numbers: length, motif count (0 unless canonical), 20 letter frequencies, largest fraction, longest run."""
    s = F.upper(text(c))
    n = F.greatest(F.length(s), F.lit(1))
    motifs = F.when(is_canonical(s), motif_count(s)).otherwise(0)
    return F.array(F.length(s).cast("double"), motifs.cast("double"), *[letter_count(s, x) / n for x in RESIDUES], max_fraction(s), max_run(s).cast("double"))


def positional_identity(a: Column, b: Column) -> Column:
    """Equal characters at equal positions, of the longer length; 0 if either is empty. a, b: arrays of characters."""
    short = F.least(F.size(a), F.size(b))
    same = F.aggregate(F.zip_with(F.slice(a, 1, short), F.slice(b, 1, short), lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.when(short > 0, same / F.greatest(F.size(a), F.size(b))).otherwise(0.0)


def wrap(c: Column, width: int = 80) -> Column:
    return F.regexp_replace(c, f"(.{{{width}}})(?!$)", "$1\n")


def joined(*parts: Column, sep: str = "; ") -> Column:
    """The filled parts; null if there is none."""
    return F.nullif(F.concat_ws(sep, *[F.nullif(p, F.lit("")) for p in parts]), F.lit(""))


def stop_reason(eos: Column, new_tokens: Column, limit: int) -> Column:
    return F.when(eos, "eos").when(new_tokens >= limit, "max_new_tokens").otherwise("other")


# Predicates


def has_keyword(*cols: Column | str, keywords: tuple[str, ...] = KEYWORDS) -> Column:
    """Case-sensitive: any keyword within any of the columns."""
    out = F.lit(False)
    for c in cols:
        for k in keywords:
            out = out | text(c).contains(k)
    return out


def has_keyword_any_case(word: str, *cols: Column | str) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | F.lower(text(c)).contains(word.lower())
    return out


def starts_with_type(*cols: Column | str, prefix: str = "VI") -> Column:
    """Stripped and upper-cased, any column begins with the prefix."""
    out = F.lit(False)
    for c in cols:
        out = out | F.upper(strip(text(c))).startswith(prefix)
    return out


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def required(*cols: Column) -> Column:
    """The first value that is neither null nor empty; a row without one is an error."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.raise_error(F.lit("neither sequence nor protein")))


def first_number(*cols: Column) -> Column:
    """The first value that can be read as a number; null if none can."""
    return F.coalesce(*[c.try_cast("double") for c in cols])


def first_problem(c: Column | str, lo: int, hi: int) -> Column:
    """The first reason why a sequence is invalid: empty, letters outside the alphabet, length; null if valid."""
    s = F.upper(text(c))
    return F.when(s == "", "empty sequence").when(~is_canonical(s), "non-canonical amino acid").when(~F.length(s).between(lo, hi), F.concat(F.lit("length "), F.length(s).cast("string"), F.lit(f" outside [{lo}, {hi}]")))


def all_problems(c: Column | str, lo: int, hi: int) -> Column:
    """All those reasons, joined with semicolons; null if valid."""
    s = F.upper(text(c))
    return joined(F.when(s == "", "empty sequence"), F.when(~is_canonical(s), "non-canonical amino acid"), F.when(~F.length(s).between(lo, hi), F.concat(F.lit("length "), F.length(s).cast("string"), F.lit(f" outside [{lo}, {hi}]"))))


def alphabet_problems(c: Column) -> Column:
    """Array of: empty_sequence, contains_whitespace, invalid_alphabet with the letters."""
    bad = invalid_letters(F.upper(c))
    return F.array_compact(F.array(F.when(c == "", "empty_sequence"), F.when(c.rlike(r"(?U)\s"), "contains_whitespace"), F.when(bad != "", F.concat(F.lit("invalid_alphabet:"), bad))))


def hard_filter(c: Column | str, length_range: tuple[int, int] = (800, 1400), max_aa_fraction: float = 0.2, run: int = 8, alphabet: bool = True, two_motifs: bool = True, low_complexity: bool = True) -> Column:
    """struct(passed, reasons, motif_positions, length, low_complexity(max_aa_fraction, max_run, is_low_complexity, reasons)).

    Every failing reason is listed. Each filter can be switched off; the measures are given all the same."""
    s = F.upper(text(c))
    lo, hi = length_range
    alpha = alphabet_problems(s)
    at = F.when(F.size(alpha) == 0, motif_positions(s)).otherwise(F.array().cast("array<int>"))
    fraction, longest = max_fraction(s), max_run(s)
    complexity = F.array_compact(F.array(F.when(fraction > max_aa_fraction, f"max_aa_fraction>{max_aa_fraction}"), F.when(longest >= run, f"max_run>={run}")))
    none = F.array().cast("array<string>")
    reasons = F.concat(
        alpha if alphabet else none,
        F.array_compact(F.array(
            F.when(~F.length(s).between(lo, hi), F.concat(F.lit("length_out_of_range:"), F.length(s).cast("string"), F.lit(f" not in [{lo},{hi}]"))),
            F.when(F.size(at) != 2, F.concat(F.lit("hepn_count:"), F.size(at).cast("string"))) if two_motifs else F.lit(None).cast("string"),
        )),
        F.transform(complexity, lambda x: F.concat(F.lit("low_complexity:"), x)) if low_complexity else none,
    )
    lc = F.struct(fraction.alias("max_aa_fraction"), longest.alias("max_run"), (F.size(complexity) > 0).alias("is_low_complexity"), complexity.alias("reasons"))
    return F.struct((F.size(reasons) == 0).alias("passed"), reasons.alias("reasons"), at.alias("motif_positions"), F.length(s).alias("length"), lc.alias("low_complexity"))
