"""Statuses of bases and intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

GOOD = "good"
#: Colour of each status in BED output.
COLOURS = {
    "good": "0,0,0",
    "null": "0,0,0",
    "indel": "128,0,128",
    "softclip": "0,255,255",
    "low_quality": "255,0,128",
    "collapse": "0,255,0",
    "misjoin": "255,128,0",
    "false_dupe": "0,0,255",
    "scaffold": "128,128,128",
    "homopolymer": "236,236,0",
    "repeat": "51,102,0",
}
REPEATS = ("scaffold", "homopolymer", "repeat")
MERGEABLE = ("low_quality", "softclip", "collapse", "misjoin")
#: Which other statuses a status takes precedence over; every status but good also over good.
#: The relation isn't an order (softclip and collapse take precedence over each other), so it can't be a rank.
OVER = {
    "softclip": ("low_quality", "collapse", *REPEATS),
    "collapse": ("low_quality", "softclip", "misjoin", *REPEATS),
    "misjoin": ("low_quality", "softclip", "collapse", *REPEATS),
}


def over(a: Column, b: Column) -> Column:
    """Whether status a takes precedence over status b."""
    strong = [(a == k) & b.isin(*v) for k, v in OVER.items()]
    return reduce(lambda x, y: x | y, strong, (b == GOOD) & (a != GOOD))


def stronger(a: Column, b: Column) -> Column:
    """a where it takes precedence over b, else b."""
    return F.when(over(a, b), a).otherwise(b)


def stronger_of(before: Column, status: Column) -> Column:
    """The images of all statuses after one more: ``before`` has those so far, in the order of COLOURS."""
    return F.transform(before, lambda x: stronger(x, status))


def image(images: Column, status: Column) -> Column:
    """Where the images of all statuses take one; a status that isn't known stays."""
    return F.coalesce(F.get(images, F.array_position(F.array(*map(F.lit, COLOURS)), status).cast("int") - 1), status)


def colour(status: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv]), status), F.lit("0,0,0"))


def known(status: Column) -> Column:
    """A known misassembly status as it is, anything else as good."""
    return F.when(status.isin(*[s for s in COLOURS if s not in ("good", "null")]), status).otherwise(F.lit(GOOD))
