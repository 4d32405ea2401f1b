"""Masks for personal data; the whole value never leaves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


HIDDEN = "•"
_DIGIT = "[0-9٠-٩۰-۹]"


def tail4(c: Column) -> Column:
    """All but the last four characters hidden; of six characters or fewer, at most three stay hidden and the rest shows."""
    n = F.length(c)
    keep = F.when(n > 6, 4).otherwise(F.greatest(F.lit(0), n - 3))
    return F.concat(F.repeat(F.lit(HIDDEN), n - keep), F.right(c, keep))


def email(c: Column) -> Column:
    """First letter and domain of each address in a text."""
    return F.regexp_replace(c, "([A-Za-z0-9])[A-Za-z0-9._%+-]*@([A-Za-z0-9-]+\\.[A-Za-z0-9.-]+)", f"$1{HIDDEN * 3}@$2")


def birth_year(c: Column) -> Column:
    """A date of which only the first run of four digits shows."""
    at = F.regexp_instr(c, F.lit("[0-9]{4}"))
    hide = lambda x: F.regexp_replace(x, "[0-9]", HIDDEN)
    shown = F.concat(hide(F.substr(c, F.lit(1), at - 1)), F.substr(c, at, F.lit(4)), hide(F.substr(c, at + 4)))
    return F.when(at > 0, shown).otherwise(hide(c))


def personal_value(value: Column, key: Column) -> Column:
    """The mask that a personal field's key asks for: contact, birth date, or any other identifier."""
    contact = key.rlike("(?i)mail") & F.contains(value, F.lit("@"))
    address = F.left(F.concat(F.left(value, F.lit(1)), F.lit(f"{HIDDEN * 3}@"), F.regexp_extract(value, "^[^@]*@(.*)$", 1)), F.lit(80))
    return F.when(contact, address).when(key.rlike("(?i)birth|dob"), birth_year(value)).otherwise(tail4(value))


def long_numbers(c: Column) -> Column:
    """Runs of nine or more digits of any of three systems, grouped by single blanks or not, show their last four only.

    A digit goes if at least four more follow it and the run has nine in all, so many before and so many after.
    """
    ways = [f"(?<={f'{_DIGIT} ?' * n}){_DIGIT}(?={f' ?{_DIGIT}' * (8 - n)})" for n in range(5)]
    return F.regexp_replace(c, "|".join(ways), HIDDEN)


def masked_tail_matches(masked: Column, value: Column) -> Column:
    """A masked number (dots or stars, then digits) agrees with a value that ends so."""
    digits = F.regexp_extract(masked, "([0-9]{3,})$", 1)
    return (digits != "") & masked.rlike("^[*.…x•]+[0-9]+$") & F.endswith(value, digits)


# Names of keys that hold a person's identifier or contact, and of parents whose ``id`` does.
PERSONAL_KEY = (
    "(?i)^(?:id(?:entity)?(?:number|no|num)|national_?id(?:number)?|nin|iqama(?:number|no)?|residen(?:t|cy)_?(?:id|number)|passport(?:number|no)?"
    "|border(?:number|no)?|gcc_?id|(?:mobile|phone|telephone|tel|fax)(?:number|no)?|e?mail(?:address)?"
    "|(?:birth_?date|birth_?day|date_?of_?birth|dob|birthdate(?:gregorian|hijri|greg)?|(?:gregorian|hijri)?birth_?date))$"
)
IDENTITY_PARENT = "(?i)^(?:identity|identifier|ident|person|personal_?id)$"


def personal_path(path: Column, listed: list[str] = ()) -> Column:
    """Whether the field at a path (``a.b[].c``) is personal: by the stated paths, by its key's name, or an ``id`` below an identity."""
    norm = F.trim(F.lower(F.replace(path, F.lit("[]"), F.lit(""))))
    parts = F.split(F.replace(path, F.lit("[]"), F.lit("")), "\\.")
    key, parent = F.element_at(parts, -1), F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    by_name = key.rlike(PERSONAL_KEY) | ((F.lower(key) == "id") & parent.rlike(IDENTITY_PARENT))
    return (norm.isin([p.replace("[]", "").lower() for p in listed]) | by_name) if listed else by_name
