"""Declarative rule sets: consistency flags and ordered repair in plain column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minekit.scale import all_present


def sure(cond: Column) -> Column:
    """A comparison with a missing value counts as false."""
    return F.coalesce(cond, F.lit(False))


def any_of(*conds: Column) -> Column:
    out = F.lit(False)
    for c in conds:
        out = out | sure(c)
    return out


@dataclass(frozen=True)
class Rule:
    """``holds`` gives the flag; it is null while a column of ``needs`` is missing."""

    name: str
    holds: Column
    needs: Sequence[str] = ()
    skip: Column | None = field(default=None)

    def flag(self) -> Column:
        out = F.when(all_present(self.needs), sure(self.holds)) if self.needs else sure(self.holds)
        return out if self.skip is None else F.when(~sure(self.skip), out)


def check_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add one nullable boolean per rule, all in one projection."""
    return df.withColumns({rule.name: rule.flag() for rule in rules})


def check_all(
    df: DataFrame,
    cleaned: Mapping[str, Column],
    rule_sets: Sequence[Sequence[Rule]],
    any_null: Sequence[str] = (),
    null_flag: str = "nan_values",
) -> DataFrame:
    """Clean the columns, then evaluate rule sets in order (later sets may read earlier flags)."""
    if any_null:
        df = df.withColumn(null_flag, ~all_present(any_null))
    df = df.withColumns(dict(cleaned))
    for rules in rule_sets:
        df = check_rules(df, rules)
    return df


def first_match(branches: Sequence[tuple[Column, Column | int | None]], default=None) -> Column:
    """Value of the first branch whose condition surely holds."""
    out = None
    for cond, value in branches:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(sure(cond), value) if out is None else out.when(sure(cond), value)
    return out.otherwise(F.lit(default) if not isinstance(default, Column) else default)


def repair(df: DataFrame, stages: Sequence[Mapping[str, Column]]) -> DataFrame:
    """Apply stages of column assignments; a stage reads the columns repaired by earlier stages."""
    for stage in stages:
        df = df.withColumns(dict(stage))
    return df


def repair_where(df: DataFrame, consistent: str, fixes: Mapping[str, Column]) -> DataFrame:
    """Apply ``fixes`` only to rows whose flag is false."""
    broken = sure(~F.col(consistent))
    return df.withColumns({c: F.when(broken, fix).otherwise(F.col(c)) for c, fix in fixes.items()})


def expand_tags(df: DataFrame, cols: Sequence[str], tag_map: Mapping[str, Sequence[str]], tags: Sequence[str]) -> DataFrame:
    """Boolean column per tag: true when any of ``cols`` maps to the tag."""
    pairs = []
    for value, listed in tag_map.items():
        pairs += [F.lit(value), F.array(*[F.lit(x) for x in listed]).cast("array<string>")]
    lookup = F.create_map(*pairs)
    none = F.array().cast("array<string>")
    found = F.flatten(F.array(*[F.coalesce(F.element_at(lookup, F.col(c)), none) for c in cols]))
    tagged = df.withColumn("__tags", found)
    return tagged.withColumns({t: F.array_contains("__tags", t) for t in tags}).drop("__tags")


def tag_conflicts(df: DataFrame, pairs: Sequence[tuple[str, bool, str, bool]]) -> DataFrame:
    """Rows per contradicting pair ``(tag_a, value_a, tag_b, value_b)``, counted in one pass."""
    names = [f"{a}={int(va)}|{b}={int(vb)}" for a, va, b, vb in pairs]
    counts = [
        F.count_if((F.col(a) == va) & (F.col(b) == vb)).alias(n) for n, (a, va, b, vb) in zip(names, pairs)
    ]
    return df.agg(*counts).unpivot([], names, "pair", "n")
