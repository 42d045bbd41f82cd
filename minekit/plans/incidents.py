"""The incident domain as configuration: cleaning, rule sets, repair stages and tags for participant tables.

Every function returns rules or column expressions over the incident column names; nothing here touches data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from minekit.functions.maths import parse_int
from minekit.operators.rules import Rule, any_of, first_match, sure

# Largest accepted age and number of participants of one incident.
MAX_AGE = 101
MAX_PARTICIPANTS = 103

# Labels that contradict or demand a tag.
NON_SHOOTING = "Non-Shooting Incident"
NON_AGGRESSION = "Non-Aggression Incident"
NO_HARM = "Home Invasion - No death or injury"
MASS_MURDER = "Mass Murder (4+ deceased victims excluding the subject/suspect/perpetrator , one location)"
MASS_SHOOTING = "Mass Shooting (4+ victims injured or killed excluding the subject/suspect/perpetrator, one location)"

AGES = ["min_age_participants", "avg_age_participants", "max_age_participants"]
BANDS = ["n_participants_child", "n_participants_teen", "n_participants_adult"]
OUTCOMES = ["n_killed", "n_injured", "n_arrested", "n_unharmed"]
ONE_BANDS = ["participant1_child", "participant1_teen", "participant1_adult"]
ONE_GENDERS = ["participant1_male", "participant1_female"]
COUNTS = [*BANDS, "n_males", "n_females", *OUTCOMES]

c = F.col


def cleaned() -> dict[str, Column]:
    """Integers in range, everything else null."""
    ages = {a: parse_int(a, 0, MAX_AGE) for a in [*AGES, "participant_age1"]}
    counts = {n: parse_int(n, 0) for n in COUNTS}
    gender = {
        "participant1_male": F.when(c("participant_gender1").isin("Male", "Female"), c("participant_gender1") == "Male"),
        "participant1_female": F.when(c("participant_gender1").isin("Male", "Female"), c("participant_gender1") == "Female"),
    }
    return {**ages, **counts, "n_participants": parse_int("n_participants", 1), **gender}


def age_bands() -> list[Rule]:
    """Minimum <= mean and maximum, band counts agree with the extremes, some band is populated."""
    lo, avg, hi = (c(a) for a in AGES)
    child, teen, adult = (c(b) for b in BANDS)
    broken = any_of(
        (lo > hi) | sure(lo > avg),
        (lo < 12) & (child <= 0),
        lo.between(12, 17) & any_of(child > 0, teen <= 0),
        (lo >= 18) & any_of(child > 0, teen > 0, adult <= 0),
        lo.isNotNull() & sure(lo > avg),
        (hi < 12) & any_of(child <= 0, teen > 0, adult > 0),
        hi.between(12, 17) & any_of(teen <= 0, adult > 0),
        (hi >= 18) & (adult <= 0),
        child + teen + adult <= 0,
    )
    return [Rule("consistency_age", ~broken)]


def totals() -> list[Rule]:
    """Genders add up; outcomes stay within the number of participants."""
    total = c("n_participants")
    bounded = (c("n_killed") + c("n_injured") <= total) & (c("n_arrested") <= total) & (c("n_unharmed") <= total)
    return [
        Rule("consistency_gender", c("n_males") + c("n_females") == total, ["n_males", "n_females", "n_participants"]),
        Rule("consistency_n_participant", bounded, [*OUTCOMES, "n_participants"]),
    ]


def single_vs_group() -> list[list[Rule]]:
    """The described participant against its own band and against the whole group; then all together."""
    age = c("participant_age1")
    own = F.when(age < 12, sure(c(ONE_BANDS[0]))).when(age < 18, sure(c(ONE_BANDS[1]))).otherwise(sure(c(ONE_BANDS[2])))

    def follows(flags: list[str], counts: list[str]) -> Column:
        return first_match([(c(f), sure(c(n) > 0)) for f, n in zip(flags, counts)])

    def silent(flags: list[str]) -> Column:
        return ~any_of(*[c(f) for f in flags])

    single = [
        Rule("consistency_participant1", own, ["participant_age1"]),
        Rule(
            "participant1_age_consistency_wrt_all_data",
            age.between(c(AGES[0]), c(AGES[2])),
            ["participant_age1", AGES[0], AGES[2]],
        ),
        Rule("participant1_age_range_consistency_wrt_all_data", follows(ONE_BANDS, BANDS), skip=silent(ONE_BANDS)),
        Rule(
            "participant1_gender_consistency_wrt_all_data",
            follows(ONE_GENDERS, ["n_males", "n_females"]),
            skip=silent(ONE_GENDERS),
        ),
    ]
    a, b, g = (c(rule.name) for rule in single[1:])
    failed = any_of(~a, ~b)
    together = Rule(
        "consistency_participants1_wrt_n_participants", ~failed & sure(g), skip=~failed & g.isNull()
    )
    return [single, [together]]


def band_flags() -> dict[str, Column]:
    band, age = c("participant_age_group1"), parse_int("participant_age1", 0, MAX_AGE)
    names = ["Child 0-11", "Teen 12-17", "Adult 18+"]
    by_age = F.when(age < 12, names[0]).when(age < 18, names[1]).when(age >= 18, names[2])
    which = F.when(band.isNull(), by_age).when(band.isin(*names), band)
    return {flag: which == n for flag, n in zip(ONE_BANDS, names)}


def repair_stages(unknown_is_consistent: bool = True) -> list[dict[str, Column]]:
    """Four stages writing ``new_*`` columns: totals and genders, outcomes, ages, the single participant.

    An unknown flag counts as consistent unless ``unknown_is_consistent`` is off.
    """
    ok = lambda name: F.coalesce(c(name), F.lit(unknown_is_consistent))
    truthy = lambda name: F.coalesce(c(name), F.lit(True))
    total, people = c("n_participants"), c("n_males") + c("n_females")
    hurt = c("n_killed") + c("n_injured")
    fits = (hurt <= people) & (c("n_arrested") <= people) & (c("n_unharmed") <= people)
    alone = (total == 1) & truthy("consistency_participant1")
    male = truthy("participant1_male")
    good_gender, good_total, good_age = ok("consistency_gender"), ok("consistency_n_participant"), ok("consistency_age")

    first = {
        "new_n_males": first_match([(good_gender | sure(fits), c("n_males")), (alone, F.when(male, 1).otherwise(0))]),
        "new_n_females": first_match([(good_gender | sure(fits), c("n_females")), (alone, F.when(male, 0).otherwise(1))]),
        "new_n_participants": first_match(
            [(good_gender, total), (fits, people), (alone, 1), (total <= MAX_PARTICIPANTS, total)]
        ),
    }
    known = c("new_n_participants").isNotNull()

    def outcome(value: str, size: Column) -> Column:
        bound = F.when(known, total).otherwise(MAX_PARTICIPANTS)
        return first_match([(good_total, c(value)), (size <= bound, c(value))])

    second = {
        "new_n_killed": outcome("n_killed", hurt),
        "new_n_injured": outcome("n_injured", hurt),
        "new_n_arrested": outcome("n_arrested", c("n_arrested")),
        "new_n_unharmed": outcome("n_unharmed", c("n_unharmed")),
    }
    # the outcome stage may restore the total, and its own branch test looks at the earlier value
    second_total = {"new_n_participants": F.when(good_total, total).otherwise(c("new_n_participants"))}

    lone = alone & truthy("participant1_age_consistency_wrt_all_data") & truthy(
        "participant1_age_range_consistency_wrt_all_data"
    )
    lo, avg, hi = (c(a) for a in AGES)
    new_total = c("new_n_participants")
    only_band = first_match(
        [
            (~good_age & sure(lone) & truthy(ONE_BANDS[0]), 0),
            (~good_age & sure(lone) & truthy(ONE_BANDS[1]), 1),
            (~good_age & sure(lone) & truthy(ONE_BANDS[2]), 2),
            (~good_age, None),
            ((new_total == 1) & (avg < 12), 0),
            ((new_total == 1) & (avg < 18), 1),
            (new_total == 1, 2),
            (hi < 12, 0),
            ((lo > 12) & (hi < 18), 1),
            (hi >= 18, 2),
        ]
    )
    kept = good_age & sure(c(BANDS[0]) + c(BANDS[1]) + c(BANDS[2]) == new_total)
    third = {f"new_{a}": first_match([(good_age, c(a)), (lone, c("participant_age1"))]) for a in AGES}
    for i, band in enumerate(BANDS):
        share = F.when(good_age, new_total).otherwise(1)
        third[f"new_{band}"] = first_match(
            [
                (kept, c(band)),
                (good_age & new_total.isNull(), F.when(c(band) <= MAX_PARTICIPANTS, c(band))),
                (only_band.isNotNull(), F.when(only_band == i, share).otherwise(0)),
            ]
        )
    trusted = truthy("consistency_participant1")
    fourth = {
        "new_participant_age1": F.when(
            trusted & truthy("participant1_age_consistency_wrt_all_data"), c("participant_age1")
        )
    }
    for flag in ONE_BANDS:
        fourth[f"new_{flag}"] = F.when(trusted & truthy("participant1_age_range_consistency_wrt_all_data"), c(flag))
    for flag in ONE_GENDERS:
        fourth[f"new_{flag}"] = F.when(trusted & truthy("participant1_gender_consistency_wrt_all_data"), c(flag))
    return [first, second, second_total, third, fourth]


def _says(label: str) -> Column:
    return any_of(c("incident_characteristics1") == label, c("incident_characteristics2") == label)


COUNTED_TAGS = {"death": "n_killed", "injuries": "n_injured", "children": "n_participants_child"}
DENIED_TAGS = {"shots": NON_SHOOTING, "aggression": NON_AGGRESSION}


def tags() -> list[Rule]:
    """Tags agree with counts, with labels that deny them, and with labels that promise victims."""
    broken = [(c(t) & (c(n) == 0)) | (~c(t) & (c(n) > 0)) for t, n in COUNTED_TAGS.items()]
    broken += [_says(label) & c(t) for t, label in DENIED_TAGS.items()]
    unharmed = any_of(c("n_killed") != 0, c("n_injured") != 0)
    few = c("n_participants") < 4
    broken += [
        _says(NO_HARM) & unharmed,
        _says(MASS_MURDER) & (c("n_killed") < 4) & few,
        _says(MASS_SHOOTING) & (c("n_killed") + c("n_injured") < 4) & few,
    ]
    return [Rule("tag_consistency", ~any_of(*broken))]


def tag_fixes() -> dict[str, Column]:
    """Counted tags follow their counts, denied tags are cleared."""
    fixes = {t: F.when(c(n) > 0, True).when(c(n) == 0, False).otherwise(c(t)) for t, n in COUNTED_TAGS.items()}
    return {**fixes, **{t: c(t) & ~_says(label) for t, label in DENIED_TAGS.items()}}
