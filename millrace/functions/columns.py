"""Column builders: JVM-side expressions that the operators are made of.

All of them are null-safe where it matters: a comparison with a null or NaN is
false, never null, and casts that can fail give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Python's str.split() sees it; Java's \s is only a part of it.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def col(x: Column | str) -> Column:
    """A column by its exact name, also if the name has dots."""
    return F.col(f"`{x}`") if isinstance(x, str) else x


def once(x: Column) -> Column:
    """A column that is computed where it is projected, and only there: the
    optimiser copies it neither into filters above nor into its users. For columns
    that cost much and are used several times. rand() only bars the way."""
    return F.when(F.rand(0) + 1 > 0, x)


def let(x: Column, use) -> Column:
    """use(x), with x computed once: an expression that use copies would be
    computed at each place, and again for each element in a lambda."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def require_columns(df: DataFrame, *names: str | None) -> None:
    """Raises before any job runs if a column is missing."""
    missing = [n for n in names if n is not None and n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def strip(x: Column | str) -> Column:
    """Without white space at both ends, of any kind (trim drops blanks only)."""
    return F.regexp_replace(col(x), rf"^{SPACE}+|{SPACE}+$", "")


def squeeze(x: Column | str) -> Column:
    """Each run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(col(x), rf"{SPACE}+", " "))


def blank(x: Column | str) -> Column:
    return F.coalesce(~col(x).rlike(rf"[^\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]"), F.lit(True))


def words(x: Column | str) -> Column:
    """The words of a text; none for a blank one."""
    return F.filter(F.split(F.coalesce(col(x), F.lit("")), rf"{SPACE}+"), lambda w: w != "")


def lines(x: Column | str) -> Column:
    """The lines that are not blank."""
    return F.filter(F.split(F.coalesce(col(x), F.lit("")), "\n"), lambda p: ~blank(p))


def occurrences(x: Column, piece: str) -> Column:
    """How often a literal piece occurs, without overlaps."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def within(x: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Whether low <= x <= high; false for null and NaN, true without bounds."""
    x = col(x).cast("double")
    if low is None and high is None:
        return F.lit(True)
    test = ~F.isnan(x)
    if low is not None:
        test &= x >= F.lit(float(low))
    if high is not None:
        test &= x <= F.lit(float(high))
    return F.coalesce(test, F.lit(False))


def doubles(x: Column | str) -> Column:
    return col(x).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors; null if one is null or zero, or sizes differ."""
    a, b = doubles(a), doubles(b)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def word_tokens(x: Column | str) -> Column:
    """Distinct lower-case runs of ASCII letters and apostrophes."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col(x), F.lit(""))), F.lit("[a-z']+"), F.lit(0)))


def tag_body(x: Column | str, tag: str) -> Column:
    """The first body of <tag>...</tag>, trimmed; empty if there is none."""
    return strip(F.regexp_extract(F.coalesce(col(x), F.lit("")), rf"(?s)<{tag}>(.*?)</{tag}>", 1))


def first_item(x: Column | str) -> Column:
    """The first element of an array, null if there is none."""
    return F.get(col(x), F.lit(0))


def seconds(timecode: Column | str) -> Column:
    """Seconds of HH:MM:SS.mmm; null if it isn't one."""

    def value(p: Column) -> Column:
        part = [F.try_element_at(p, F.lit(k)).try_cast("double") for k in (1, 2, 3)]
        return F.when(F.size(p) == 3, part[0] * 3600 + part[1] * 60 + part[2])

    # The lambda's variable holds the parts, so that they are split once.
    return F.get(F.transform(F.array(F.split(col(timecode), ":")), value), F.lit(0))


def timecode(sec: Column | str) -> Column:
    """HH:MM:SS.mmm of seconds; negative ones count as 0."""

    def padded(x: Column, most: int) -> Column:
        """With leading zeros; a longer number stays whole."""
        zeros = [F.when(x < 10**k, "0").otherwise("") for k in range(most - 1, 0, -1)]
        return F.concat(*zeros, x.cast("string"))

    def show(ms: Column) -> Column:
        h, m, s = (F.floor(ms / k) for k in (3600000, 60000, 1000))
        return F.concat(padded(h, 2), F.lit(":"), padded(m % 60, 2), F.lit(":"), padded(s % 60, 2), F.lit("."), padded(ms % 1000, 3))

    # Formatting by a pattern takes many times as long.
    return let(F.round(F.greatest(col(sec).cast("double"), F.lit(0.0)) * 1000).cast("long"), show)


def frame_index(sec: Column | str, fps: Column | str) -> Column:
    """The frame at a second, floor(sec * fps); 0 without a frame rate."""
    return F.when(col(fps) > 0, F.floor(col(sec) * col(fps)).cast("int")).otherwise(F.lit(0))


def even_frames(total: Column | str, load: int) -> Column:
    """Indices of min(load, total) frames at even distances, first and last included."""
    total = col(total).cast("int")
    n = F.least(F.lit(load), total)
    some = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.floor(k * (total - 1) / (n - 1)).cast("int"))
    return F.when(total <= 0, F.array().cast("array<int>")).when(n == 1, F.array(F.lit(0))).otherwise(some)


def pick(key: Column, seed: int, choices: int) -> Column:
    """A number in 0..choices-1 that depends on the key and the seed only, so
    that it is the same on every retry and partitioning."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(choices)).cast("int")
