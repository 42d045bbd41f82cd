"""Text expressions: case, cleaning, place names, edit distance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from minekit.scale import col

# Words ignored in street addresses.
FREQUENT_WORDS = [
    "of", "block", "Street", "and", "Avenue", "St", "Ave", "Road", "Drive", "Rd", "South", "West",
    "N", "North", "Dr", "S", "W", "E", "East", "Blvd", "Boulevard",
]
# Length-to-typo ratios of the place checks.
RATIO_STATE = 10
RATIO_CITY = 7
RATIO_ADDRESS = 4
RATIO_GENERAL = 8
ADDRESS_WORD_PAIRS = 2


def strip_ws(c: str | Column) -> Column:
    """Remove blanks and tabs."""
    return F.translate(col(c), " \t", "")


def strip_punct(c: str | Column) -> Column:
    """Remove everything but letters, digits, underscore, white space and parentheses."""
    return F.regexp_replace(col(c), r"[^\p{L}\p{N}_\s()]", "")


def strip_digits(c: str | Column) -> Column:
    return F.regexp_replace(col(c), "[0-9]", "")


def has_paren(c: str | Column) -> Column:
    return F.contains(col(c), F.lit("("))


def split_paren(c: str | Column) -> Column:
    """``a (b)`` -> [``a ``, ``b``]; text without a parenthesis -> [text]."""
    c = col(c)
    inside = F.replace(F.substring_index(c, "(", -1), F.lit(")"), F.lit(""))
    return F.when(has_paren(c), F.array(F.substring_index(c, "(", 1), inside)).when(
        c.isNotNull(), F.array(c)
    )


def _drop_place_words(c: Column) -> Column:
    lowered = F.replace(F.lower(c), F.lit("county"), F.lit(""))
    return F.replace(lowered, F.lit("city of"), F.lit(""))


def norm_place(c: str | Column) -> Column:
    """Place name -> array of one or two bare names (outside and inside the parentheses)."""
    bare = strip_digits(strip_ws(_drop_place_words(col(c))))
    return F.transform(split_paren(bare), strip_punct)


def norm_place_scalar(c: str | Column) -> Column:
    """Null-safe scalar variant: digits and punctuation go before the blanks."""
    return strip_ws(strip_punct(strip_digits(_drop_place_words(col(c)))))


def map_value(c: str | Column, mapping: Mapping[str, object], default: Column | None = None) -> Column:
    """Replace by a literal map; unmapped values keep ``default`` (null when not given)."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.element_at(F.create_map(*pairs), col(c))
    return found if default is None else F.coalesce(found, default)


def alias(c: str | Column, mapping: Mapping[str, str]) -> Column:
    """Special spellings -> canonical spelling, other values unchanged."""
    return map_value(c, mapping, col(c))


def _distances(a: list[str], b: list[str]) -> np.ndarray:
    """Damerau-Levenshtein distance (unrestricted transpositions) of many pairs, one numpy step per cell."""
    n, rows = len(a), np.arange(len(a))
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    wide_a, wide_b = int(la.max(initial=0)), int(lb.max(initial=0))
    letters = {ch: i + 2 for i, ch in enumerate(sorted(set("".join(a) + "".join(b))))}
    left, right = np.zeros((n, wide_a), int), np.ones((n, wide_b), int)  # paddings never agree
    for k in range(n):
        left[k, : la[k]] = [letters[ch] for ch in a[k]]
        right[k, : lb[k]] = [letters[ch] for ch in b[k]]
    grid = np.full((wide_a + 2, wide_b + 2, n), wide_a + wide_b, np.int32)
    grid[1:, 1] = np.arange(wide_a + 1)[:, None]
    grid[1, 1:] = np.arange(wide_b + 1)[:, None]
    last_row = np.zeros((len(letters) + 2, n), int)
    for i in range(1, wide_a + 1):
        last_col = np.zeros(n, int)
        for j in range(1, wide_b + 1):
            row, equal = last_row[right[:, j - 1], rows], left[:, i - 1] == right[:, j - 1]
            swap = grid[row, last_col, rows] + (i - row) + (j - last_col) - 1
            edit = np.minimum(grid[i, j] + ~equal, np.minimum(grid[i + 1, j], grid[i, j + 1]) + 1)
            grid[i + 1, j + 1] = np.minimum(edit, swap)
            last_col[equal] = j
        last_row[left[:, i - 1], rows] = i
    return grid[la + 1, lb + 1, rows]


def _distance_map(pairs: set[tuple[str, str]]) -> dict[tuple[str, str], int]:
    """Distances of distinct pairs; pairs of similar size share a step, a step stays within a few MB."""
    todo = sorted(pairs, key=lambda p: (len(p[0]) + len(p[1]), p))
    out: dict[tuple[str, str], int] = {}
    start = 0
    while start < len(todo):
        stop = start + 1
        longest = max(map(len, todo[start]))
        while stop < len(todo):
            longest = max(longest, *map(len, todo[stop]))
            if (longest + 2) ** 2 * (stop - start + 1) > 4_000_000:
                break
            stop += 1
        part = todo[start:stop]
        out.update(zip(part, _distances([p[0] for p in part], [p[1] for p in part]).tolist()))
        start = stop
    return out


@F.pandas_udf(IntegerType())
def dl_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Damerau-Levenshtein distance with unrestricted transpositions; null when a side is null."""
    pairs = list(zip(a, b))
    known = _distance_map({p for p in pairs if p[0] is not None and p[1] is not None})
    return pd.Series([known.get(p) for p in pairs], dtype="Int32")


def typo_limit(a: Column, b: Column, ratio: int) -> Column:
    return F.floor(F.greatest(F.length(a), F.length(b)) / ratio).cast("int")


def typo_match(a: str | Column, b: str | Column, ratio: int = RATIO_STATE) -> Column:
    """1 equal up to ``floor(longest / ratio)`` typos, -1 different, 0 when a side is null.

    The JVM ``levenshtein`` settles nearly all pairs: it is never below the wanted distance and never
    above twice that distance. Only pairs in between reach the Arrow UDF.
    """
    a, b = col(a), col(b)
    limit = typo_limit(a, b, ratio)
    plain = F.levenshtein(a, b)
    open_case = (plain > limit) & (plain <= 2 * limit)
    exact = dl_distance(F.when(open_case, a), F.when(open_case, b))
    return (
        F.when(a.isNull() | b.isNull(), 0)
        .when(plain <= limit, 1)
        .when(F.coalesce(exact <= limit, F.lit(False)), 1)
        .otherwise(-1)
    )


def _swapped(a: Column, b: Column) -> Column:
    """True when two neighbouring letters of ``a`` have changed places in ``b``."""
    places = F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1)))
    turned = lambda i: F.concat(a.substr(F.lit(1), i - 1), a.substr(i + 1, F.lit(1)), a.substr(i, F.lit(1)), a.substr(i + 2, F.length(a)))
    return (F.length(a) == F.length(b)) & F.exists(places, lambda i: turned(i) == b)


def _typos_of(a: Column, b: Column) -> Column:
    """Damerau-Levenshtein distance with unrestricted transpositions of two non-empty texts, row by row on the JVM."""

    def cell(rows: Column, row: Column, i: Column, j: Column) -> Column:
        mine, other = a.substr(i, F.lit(1)), b.substr(j, F.lit(1))
        # how far back the other's letter stands in each text, 0 if nowhere
        back_a, back_b = F.instr(F.reverse(a.substr(F.lit(1), i - 1)), other), F.instr(F.reverse(b.substr(F.lit(1), j - 1)), mine)
        turned = F.get(F.get(rows, i - back_a - 1), j - back_b - 1) + back_a + back_b - 1
        swap = F.when((back_a > 0) & (back_b > 0), turned)
        change = F.get(F.get(rows, i - 1), j - 1) + F.when(mine == other, 0).otherwise(1)
        return F.least(change, F.get(F.get(rows, i - 1), j) + 1, F.get(row, j - 1) + 1, swap)

    across = lambda rows, i: F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(i), lambda row, j: F.concat(row, F.array(cell(rows, row, i, j))))
    rows = F.aggregate(F.sequence(F.lit(1), F.length(a)), F.array(F.sequence(F.lit(0), F.length(b))), lambda rows, i: F.concat(rows, F.array(across(rows, i))))
    return F.element_at(F.element_at(rows, -1), -1)


def agreeing_pairs(u: Column, v: Column, ratio: int) -> Column:
    """How many word pairs of two arrays agree up to ``floor(longest / ratio)`` typos; null if an array is null.

    All on the JVM: the built-in ``levenshtein`` and, for one typo, a look for a swap settle nearly all pairs; only where the limit
    is two or more and the plain distance lies between the limit and its double are transpositions counted in full.
    """

    def close(x: Column, y: Column) -> Column:
        limit, plain = typo_limit(x, y, ratio), F.levenshtein(x, y)
        near = (F.abs(F.length(x) - F.length(y)) <= limit) & (limit > 0)
        swaps = F.when(limit == 1, _swapped(x, y)).otherwise(_typos_of(x, y) <= limit)
        return F.when(x == y, True).when(~near | (plain > 2 * limit), False).when(plain <= limit, True).otherwise(swaps)

    return F.aggregate(u, F.when(v.isNotNull(), 0), lambda n, x: n + F.size(F.filter(v, lambda y: close(x, y))))


def address_match(
    a: str | Column,
    b: str | Column,
    stop: Sequence[str] = tuple(FREQUENT_WORDS),
    ratio: int = RATIO_ADDRESS,
    pairs: int = ADDRESS_WORD_PAIRS,
) -> Column:
    """1 when at least ``pairs`` word pairs of two addresses agree up to typos, else -1; 0 on null."""
    left = col(a)
    for word in stop:
        left = F.replace(left, F.lit(word), F.lit(" "))

    count = agreeing_pairs(F.split(left, " "), F.split(F.translate(col(b), " ", ","), ","), ratio)
    return F.when(count.isNull(), 0).when(count >= pairs, 1).otherwise(-1)


def part_score(word: str | Column, text: str | Column, ratio: int = RATIO_GENERAL) -> Column:
    """Best score of ``word`` against the comma separated parts of ``text``: contained or within typos.

    A part contains the word as is, or equals it after place normalisation up to typos.
    """
    word, parts = col(word), F.split(col(text), ",")
    contained = F.exists(parts, lambda p: F.contains(p, word))

    open_word = F.when(~F.coalesce(contained, F.lit(False)), word)
    agreeing = agreeing_pairs(F.array(F.coalesce(open_word, F.lit(""))), F.transform(parts, norm_place_scalar), ratio)
    score = F.when(open_word.isNotNull() & (agreeing > 0), 1).otherwise(-1)
    return F.when(word.isNull(), 0).when(contained, 1).otherwise(score)


def words(c: str | Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(col(c)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_counts(df: DataFrame, text: str, stop: Sequence[str] = ()) -> DataFrame:
    """Word frequencies over a text column, stop words removed."""
    exploded = df.select(F.explode(words(text)).alias("word"))
    if stop:
        exploded = exploded.where(~F.col("word").isin(*stop))
    return exploded.groupBy("word").agg(F.count("*").alias("n"))
