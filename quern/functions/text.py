"""Text rules shared by all packs: Unicode trim, strict number texts, locale number texts, binding of intermediate values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a decimal integer and as a float. Casts are looser, so every cast stands behind one of these.
INTEGER = r"^[+-]?[0-9]+$"
FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
SPECIAL = r"^(?i)[+-]?(nan|inf|infinity)$"
I64 = (-(2**63), 2**63 - 1)
U64_MAX = 2**64 - 1


def whole(n: int) -> Column:
    """A literal of any size."""
    return F.lit(str(n)).cast("decimal(38,0)")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often the body mentions it."""
    return F.transform(F.array(value), body)[0]


def trim(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def trim_bound(c: Column) -> Column:
    """`trim` of a text that is mostly trimmed already: one between two printed ASCII characters is spared the pattern."""

    def one(x: Column) -> Column:
        bare = F.left(x, F.lit(1)).between("!", "~") & F.right(x, F.lit(1)).between("!", "~")
        return F.when(bare, x).otherwise(trim(x))

    return let(c, one)


def matches(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def has(c: Column, part: str) -> Column:
    return F.coalesce(F.contains(c, F.lit(part)), F.lit(False))


def group(c: Column, pattern: str, n: int) -> Column:
    """Group `n` of the pattern, or NULL where it doesn't match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, n))


def plain_float(c: Column) -> Column:
    """The number of a finite float text, else NULL. Too large ones are infinite."""
    return F.when(c.rlike(FLOAT), c.try_cast("double"))


def any_float(c: Column) -> Column:
    """A float text's number; NaN and infinities included."""
    low = F.lower(c)
    special = F.when(low.rlike("nan$"), F.lit(float("nan"))).when(low.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(c.rlike(SPECIAL), special).otherwise(plain_float(c))


def integer(c: Column) -> Column:
    """The value of an integer text as DECIMAL(38,0), NULL if it isn't one or is longer than that."""
    return F.when(c.rlike(INTEGER), c.try_cast("decimal(38,0)"))


def whole_number(c: Column) -> Column:
    """Whether a text is an integer's; most others are told by their first and last character."""
    return F.right(c, F.lit(1)).between("0", "9") & c.rlike(INTEGER)


def if_float(c: Column) -> Column:
    """The text itself where it is a float text."""
    return let(c, lambda x: F.when(x.rlike(FLOAT) | x.rlike(SPECIAL), x))


def us_thousands(c: Column) -> Column:
    """`1,234.56` -> `1234.56`, else NULL."""
    return F.when(c.rlike(r"^-*[0-9]{1,3}(,[0-9]{3})+(\.[^,]*)?$"), if_float(F.replace(c, F.lit(","), F.lit(""))))


def european(c: Column) -> Column:
    """`1.234,56` -> `1234.56` (the grouping isn't looked at), `1.234.567` -> `1234567`, else NULL."""
    decimal = F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(c.rlike(r"\.[^.]*,[^.]*$"), if_float(decimal)).when(c.rlike(r"^[^,]*\.[^,]*\.[^,]*$"), if_float(F.replace(c, F.lit("."), F.lit(""))))


def other_thousands(c: Column) -> Column:
    """Apostrophes, or else spaces, between groups of three; comma or dot before decimals."""
    dotted = lambda sep: if_float(F.replace(F.replace(c, F.lit(sep), F.lit("")), F.lit(","), F.lit(".")))
    return F.when(has(c, "'"), F.when(c.rlike(r"^-*[0-9]{1,3}('[0-9]{3})+([.,].*)?$"), dotted("'"))).when(
        c.rlike(r"^-*[0-9]{1,3}( [0-9]{3})+([.,].*)?$"), dotted(" ")
    )


def underscores(c: Column) -> Column:
    """`1_000` -> `1000`; not at an end, not doubled. What is left may be any text."""
    bare = F.replace(c, F.lit("_"), F.lit(""))
    return F.when(has(c, "_") & ~c.rlike(r"^-?_|_$|__") & (bare != ""), bare)


def radix(c: Column) -> Column:
    """The value of 0x, 0o or 0b digits as DECIMAL(20,0), NULL beyond 64 signed bits."""

    def value(base: int) -> Callable[[Column], Column]:
        # Digits are the second group, the sign the first; both are empty where nothing matches.
        return lambda x: F.when(F.get(x, 1) != "", F.concat(F.get(x, 0), F.conv(F.get(x, 1), base, 10)).try_cast("decimal(20,0)"))

    out = F.lit(None).cast("decimal(20,0)")
    for prefix, digits, base, most in (("[xX]", "0-9a-fA-F", 16, 16), ("[oO]", "0-7", 8, 21), ("[bB]", "01", 2, 63)):
        pattern = rf"^0{prefix}([+-]?)0*([{digits}]{{1,{most}}})$"
        groups = F.array(F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2))
        out = F.when(c.rlike(f"^0{prefix}"), let(groups, value(base))).otherwise(out)
    within = lambda v: F.when(v.between(*map(whole, I64)), v)
    return F.when(c.rlike("^0[xXoObB]"), let(out, within))
