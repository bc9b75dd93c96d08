"""Rules on names, paths, questions and numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The forms of two kinds of question.
COMPOSITION = r"(?i)made of (.+?) that is used for (.+?)\??$"
ODD_ONE_OUT = r"(?i)NOT made of (.+?)\??$"
#: Phases in the order of a recording.
PHASES = ("clutter", "interaction", "clean")


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.when(F.regexp_like(text, F.lit(pattern)), F.trim(F.regexp_extract(text, pattern, group)))


def composition_parts(question: Column) -> tuple[Column, Column]:
    """Material and function that a composition question asks for; null where it is no such question."""
    return _found(question, COMPOSITION, 1), _found(question, COMPOSITION, 2)


def odd_one_out_part(question: Column) -> Column:
    """The material that an odd-one-out question names."""
    return _found(question, ODD_ONE_OUT, 1)


def repaired_path(path: Column) -> Column:
    """Whole numbers written as fractions in inner path segments (/0.0/) without the fraction."""
    return F.regexp_replace(path, r"/(\d+)\.0(?=/)", "/$1")


def swapped_segment(path: Column, source: str, target: str) -> Column:
    """path with the first segment `source` replaced; unchanged without one."""
    at = F.instr(path, f"/{source}/")
    swapped = F.concat(F.substr(path, F.lit(1), at - 1), F.lit(f"/{target}/"), F.substr(path, at + len(source) + 2))
    return F.when(at > 0, swapped).otherwise(path)


def stem(path: Column) -> Column:
    """The last segment without its last extension."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def trailing_number(*texts: Column) -> Column:
    """The number at the end of the first text that has one; 0 if none does."""
    return F.coalesce(*[F.when(F.regexp_like(t, F.lit(r"\d+$")), F.regexp_extract(t, r"(\d+)$", 1).cast("long")) for t in texts], F.lit(0).cast("long"))


def squeezed(text: Column) -> Column:
    """Lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def material_atoms(value: Column) -> Column:
    """The different materials of a compound one (parts at / and &)."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(value, "[/&]"), squeezed), lambda a: a != "")))


def display_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), "_", " ")


def display_question(question: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(question, "_", " "), r"\s+", " "))


def prompt_text(colour: Column, name: Column) -> Column:
    """The words that a detector is prompted with."""
    return F.trim(F.concat_ws(" ", colour, display_name(name)))


def referring_expression(question: Column) -> Column:
    """A question as a noun phrase: "Which object is X?" becomes "the object X"."""
    plain = F.regexp_replace(display_question(question), r"\?+$", "")
    lower = F.lower(plain)
    return (
        F.when(lower.startswith("which object is "), F.concat(F.lit("the object "), F.substr(plain, F.lit(17))))
        .when(lower.startswith("what is the object "), F.concat(F.lit("the object "), F.substr(plain, F.lit(20))))
        .when(lower.startswith("which object "), F.concat(F.lit("the object "), F.substr(plain, F.lit(14))))
        .otherwise(plain)
    )


def filled(template: Column, **values: Column) -> Column:
    """template with {name} replaced by each value."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def report_cell(value: Column, places: int, fallback: str = "--") -> Column:
    """A finite number with so many places, else the fallback."""
    fine = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(fine, F.format_string(f"%.{places}f", value)).otherwise(F.lit(fallback))


def latex_row(label: Column, *cells: Column) -> Column:
    return F.concat(F.concat_ws(" & ", label, *cells), F.lit(r" \\"))


def half_even(value: Column, places: int) -> Column:
    """Rounding with ties to the even digit, as array libraries round."""
    return F.bround(value, places)


def phase_rank(phase: Column, order: tuple[str, ...] = PHASES) -> Column:
    """Place of a phase; unknown ones share the place after the last, so sort by (rank, phase)."""
    at = F.array_position(F.array(*[F.lit(p) for p in order]), phase)
    return F.when(at > 0, at - 1).otherwise(len(order)).cast("int")


def centred(flag: Column, x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """The known flag, else whether the box's middle lies in the middle half of both axes; false without a box."""
    x, y = (x1 + x2) / (2 * width), (y1 + y2) / (2 * height)
    return F.coalesce(flag, x.between(0.25, 0.75) & y.between(0.25, 0.75), F.lit(False))
