"""Text expressions: word normalisation, labels, masks, CSV cells and codes (STR-01 to STR-06, PRJ-07 to PRJ-09, PRJ-11, PRJ-12, FLT-05, FLT-06)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One letter for each tracking state.
STATE_CODES = {"tracked": "T", "interpolated": "I", "held": "H", "fallback": "F", "absent": "A"}

# Bone names by class, the first that matches.
BONE_CLASSES = (
    ("finger", "^(thumb|index|middle|ring|pinky)_"),
    ("wrist", "^hand_"),
    ("arm", "^(upperarm|lowerarm|shoulder)"),
    ("face", "^(jaw|eyelid|eyebrow|mouth|eye_)"),
)

# Findings of the quality report that are tolerated.
TOLERATED = ("^hand resets to rest pose while tracked$", r"^\d+ one-frame finger spikes")

#: A number with its fraction and exponent.
NUMBER = r"\d+(\.\d+)?(e-?\d+)?"


def normalise_word(word: Column) -> Column:
    """Lower case; only a-z and 0-9 stay."""
    return F.regexp_replace(F.lower(word), "[^a-z0-9]", "")


def mask_numbers(text: Column) -> Column:
    """Every number becomes ``#``, so that messages that differ in figures only fall together."""
    return F.regexp_replace(text, NUMBER, "#")


def csv_cell(value: Column) -> Column:
    """A cell in double quotes, with quotes doubled, if it holds a quote, comma or line end; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def bone_class(name: Column) -> Column:
    out = F
    for label, pattern in BONE_CLASSES:
        out = out.when(name.rlike(pattern), F.lit(label))
    return out.otherwise(F.lit("trunk"))


def state_code(state: Column) -> Column:
    """The state's letter; null for an unknown state."""
    out = F
    for name, code in STATE_CODES.items():
        out = out.when(state == name, F.lit(code))
    return out


def phase_states(hold_in: Column, stroke: Column, hold_out: Column, moving: Column) -> Column:
    """Absent through the holds, tracked through the stroke (absent throughout for a hand that does not move)."""
    middle = F.when(moving, F.lit("T")).otherwise(F.lit("A"))
    return F.concat(F.expr("''"), F.repeat(F.lit("A"), hold_in), F.repeat(middle, stroke), F.repeat(F.lit("A"), hold_out))


def phase(frame: Column, hold_in: Column, stroke: Column) -> Column:
    return F.when(frame < hold_in, "Ease in").when(frame < hold_in + stroke, "Sign").otherwise("Return")


def search_key(text: Column) -> Column:
    """Lower case without white space and slashes."""
    return F.regexp_replace(F.lower(text), r"[\s/]", "")


def coerce(value: Column, allowed: list[str], default: str | None = None) -> Column:
    """The value if it is one of the allowed ones, else the default."""
    return F.when(value.isin(allowed), value).otherwise(F.lit(default))


def reasons(**tests: Column) -> Column:
    """The names of all tests that hold, in the order given; a null test does not hold."""
    return F.filter(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())), lambda x: x.isNotNull())


def tolerated(finding: Column) -> Column:
    """Whether a finding is one that describes the recording and not the joints."""
    return finding.rlike(TOLERATED[0]) | finding.rlike(TOLERATED[1])


def word_filters(hands: Column, recognised: Column, attention: Column, reviewed: Column) -> dict[str, Column]:
    """The word list's filters by name; a word without a round trip (``recognised`` null) is not misread, nulls elsewhere count as no."""
    done = F.coalesce(reviewed, F.lit(False))
    return {
        "all": F.lit(True),
        "two": F.coalesce(hands == "both", F.lit(False)),
        "attention": F.coalesce(attention, F.lit(False)),
        "misread": ~F.coalesce(recognised, F.lit(True)),
        "unreviewed": ~done,
        "reviewed": done,
    }


def found_in(search: str, gloss: Column, label: Column) -> Column:
    """Whether a search text is part of the gloss or of its label, case and white space aside (in the label slashes too); an empty one is part of all."""
    wanted = "".join(search.lower().split())
    return F.contains(F.lower(gloss), F.lit(wanted)) | F.contains(search_key(label), F.lit(wanted))
