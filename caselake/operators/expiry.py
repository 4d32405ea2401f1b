"""When a document stops being valid: dates after labels, issue date and term, declared states, and the verdict of them all.

Dates and labels stay nested arrays of their document, so a label meets its dates without any join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from .variants import let

#: Characters after a label in which its date begins, and in which words may say that it belongs to something else.
DATE_REACH, SUBJECT_REACH = 90, 28
_SELF = r"(?:هذه\s+|هذا\s+)?(?:الوكاله|الوثيقه|الصك|العقد|التفويض|الرخصه|الشهاده|الحجه)"
# Wordings of an expiry label by rank, in the folded form; rank 3 names the instrument itself.
LABELS = {
    3: (
        r"تاريخ\s+(?:انتهاء|نهايه|انهاء)\s+" + _SELF, r"مده\s+" + _SELF + r"\s+وتاريخ\s+انتهايها", r"(?:تنتهي|ينتهي|تسري|يسري)\s+" + _SELF + r"\s*(?:في|بتاريخ|حتى|الى)",
        r"تاريخ\s+انتهاء\s+الصلاحيه", r"(?:expiry|expiration)\s+date", r"date\s+of\s+expiry",
    ),
    2: (
        r"تاريخ\s+(?:الانتهاء|النهايه)", r"انتهاء\s+الصلاحيه", r"نهايه\s+(?:المده|مده\s+" + _SELF + ")", r"(?:صالحه|صالح|ساريه|ساري|نافذه)\s+(?:حتى|لغايه|الى)",
        r"(?:تنتهي|ينتهي)\s+(?:بتاريخ|في\s+تاريخ)", r"valid\s+(?:until|through|to)", r"expires?\s+on",
    ),
    1: (r"تاريخ\s+انتهاء", r"(?:تنتهي|ينتهي)\s+في", r"(?:حتى|لغايه)\s+تاريخ", r"expiry"),
}
# Words after a label that make it the date of another document; labels of an issue date, in order; states and their words.
NOT_OURS = (
    "هويه", "اقامه", "جواز", "بطاقه", "رخصه القياده", "السجل التجاري", "العضويه", "التامين", "الاشتراك", "الضمان",
    "passport", "identity card", "id card", "iqama", "driving licence", "driving license", "membership", "insurance",
)
ISSUE_LABELS = ("تاريخ الوكاله", "تاريخ الاصدار", "تاريخ التحرير", "تاريخ الصك", "حررت في", "تاريخ العقد", "بتاريخ")
STATE_LABELS = ("حاله الوكاله", "حاله الصك", "حاله الوثيقه", "الحاله", "status")
STATES = {
    "ملغاه": "cancelled", "ملغيه": "cancelled", "ملغى": "cancelled", "منسوخه": "cancelled", "معزوله": "cancelled", "موقوفه": "suspended", "موقوف": "suspended", "معلقه": "suspended",
    "منتهيه": "declared_expired", "منتهي": "declared_expired", "cancelled": "cancelled", "revoked": "cancelled", "suspended": "suspended", "expired": "declared_expired",
}
EXPIRY_KEYS = ("wakala_expiry_date_hijri", "expiry_date", "expiry_date_hijri", "expiry_date_gregorian", "contract_expiry_date")

#: Any wording; a look at its first sign spares the wordings at most places.
_ANY_LABEL = "(?iu)(?=[تيمانصسحلedv])(?:" + "|".join(f"(?:{p})" for rank in (3, 2, 1) for p in LABELS[rank]) + ")"


def label_rank(phrase: Column) -> Column:
    """The highest rank of which a wording covers the whole phrase."""
    whole = lambda rank: "(?iu)^(?:" + "|".join(LABELS[rank]) + ")$"
    return F.when(phrase.rlike(whole(3)), 3).when(phrase.rlike(whole(2)), 2).otherwise(1)


def _foreign(text: Column, end: Column) -> Column:
    return F.lower(F.substr(text, end + 1, F.lit(SUBJECT_REACH))).rlike("|".join(NOT_OURS))


def labelled_date(text: Column, dates: Column) -> Column:
    """As-of match in a ``dated_text``: struct(rank, early, label, date) of the best label with a date within reach after it, or null.

    The first date after a label counts; one on a later line lowers its rank by one. Highest rank first, then the earliest date.
    """

    def of(label: Column) -> Column:
        near = F.filter(dates, lambda p: p["start"].between(label["end"], label["end"] + DATE_REACH))

        def met(date: Column) -> Column:
            later = F.contains(F.substr(text, label["end"] + 1, date["start"] - label["end"]), F.lit("\n"))
            rank = label_rank(label["text"]) - F.when(later, 1).otherwise(0)
            ours = date.isNotNull() & ~_foreign(text, label["end"])
            return F.when(ours, F.struct(rank.alias("rank"), (-date["start"]).alias("early"), label["text"].alias("label"), date.alias("date")))

        return let(F.try_element_at(near, F.lit(1)), met)

    return F.when(F.size(dates) > 0, F.array_max(F.transform(X.find_spans(text, _ANY_LABEL), of)))


def issue_date(text: Column, dates: Column) -> Column:
    """The date within reach after the first issue label, in the labels' order, that has one; else the first date of the text."""

    def first(x: Column) -> Column:
        hits = []
        for label in ISSUE_LABELS:
            after = lambda s: F.try_element_at(F.filter(x["dates"], lambda p: p["start"].between(s["end"], s["end"] + DATE_REACH)), F.lit(1))
            found = F.filter(F.transform(X.find_spans(x["text"], label), after), lambda p: p.isNotNull())
            hits.append(F.when(F.contains(x["text"], F.lit(label)), F.try_element_at(found, F.lit(1))))
        return F.when(F.size(x["dates"]) > 0, F.coalesce(*hits, F.try_element_at(x["dates"], F.lit(1))))

    return let(F.struct(text.alias("text"), dates.alias("dates")), first)


def declared_state(fields: Column) -> Column:
    """State that a labelled field declares, from array<struct<key, label, value>>: by the first such field whose value has a known word."""

    def of(f: Column) -> Column:
        label, value = (F.lower(F.trim(D.dated_text(F.coalesce(f[c], F.lit(""))))) for c in ("label", "value"))
        key = F.coalesce(f["key"], F.lit(""))
        named = key.rlike("(_status|^status)$") | label.rlike("^(" + "|".join(STATE_LABELS) + ")")
        state = let(value, lambda v: F.coalesce(*(F.when(F.contains(v, F.lit(word)), s) for word, s in STATES.items())))
        return F.when(named, state)

    return F.try_element_at(F.filter(F.transform(fields, of), lambda s: s.isNotNull()), F.lit(1))


def field_date(fields: Column) -> Column:
    """The first date of the first field that is an expiry by its key, or by a label of rank 2 or more that is not another document's."""

    def of(f: Column) -> Column:
        label = F.lower(F.trim(D.dated_text(F.coalesce(f["label"], F.lit("")))))
        hit = lambda t: F.try_element_at(X.find_spans(t, _ANY_LABEL), F.lit(1))
        named = let(label, lambda t: let(hit(t), lambda h: h.isNotNull() & (label_rank(h["text"]) >= 2) & ~_foreign(t, h["end"])))
        date = F.try_element_at(D.dates_in(D.dated_text(F.coalesce(f["value"], F.lit("")))), F.lit(1))
        return F.when(F.coalesce(f["key"].isin(*EXPIRY_KEYS), F.lit(False)) | F.coalesce(named, F.lit(False)), date)

    return F.try_element_at(F.filter(F.transform(fields, of), lambda d: d.isNotNull()), F.lit(1))


def verdict(text: Column, dates: Column, fields: Column, as_of: Column, model: Column | None = None, model_verified: Column | None = None, from_term: bool = False) -> Column:
    """struct(status, basis, expires, days, confidence, state, text): the cascade field, label, model, issue date and term.

    ``text`` is a ``dated_text``, ``dates`` its dates, ``model`` an optional date of their type from elsewhere. A model's date that
    the text does not carry, and a month without a day, give no verdict (status unknown). Terms count only if asked for.
    """
    term = F.date_add(issue_date(text, dates)["on"], D.days_of_duration(text)) if from_term else F.lit(None).cast("date")
    facts = [field_date(fields).alias("field"), labelled_date(text, dates)["date"].alias("label"), F.coalesce(declared_state(fields), F.lit("")).alias("state")]
    if model is not None:
        facts.append(model.alias("model"))
    sure = F.lit(False) if model_verified is None else model_verified

    def decided(x: Column) -> Column:
        date, basis = x["date"], x["basis"]
        usable = date["on"].isNotNull() & ((basis != "model") | sure)
        derived = date.isNull() & x["term"].isNotNull()
        expires = F.when(derived, x["term"]).otherwise(date["on"])
        known = F.coalesce(usable, F.lit(False)) | derived
        verified = basis.isin("template_field", "label") & F.contains(text, date["text"])
        return F.struct(
            F.when(known, D.expiry_status(expires, as_of)).otherwise("unknown").alias("status"),
            F.coalesce(F.when(derived, "duration").otherwise(basis), F.lit("")).alias("basis"),
            expires.alias("expires"),
            F.when(known, F.datediff(expires, as_of)).alias("days"),
            F.when(~known | derived, "low").when(F.coalesce(verified, F.lit(False)), "high").otherwise("medium").alias("confidence"),
            x["state"].alias("state"),
            date["text"].alias("text"),
        )

    def chosen(x: Column) -> Column:
        other = x["model"] if model is not None else F.lit(None)
        basis = F.when(x["field"].isNotNull(), "template_field").when(x["label"].isNotNull(), "label").when(other.isNotNull(), "model")
        # a term is read only where nothing gives a date
        return F.struct(
            (F.coalesce(x["field"], x["label"], other) if model is not None else F.coalesce(x["field"], x["label"])).alias("date"), basis.alias("basis"), F.when(basis.isNull(), term).alias("term"), x["state"].alias("state")
        )

    # each source is worked out once, though the answer names it many times
    return let(let(F.struct(*facts), chosen), decided)


def with_evidence(found: Column, locate: Callable[[Column], Column] | None = None, verify: Callable[[Column], Column] | None = None, restore: Callable[[Column], Column] | None = None) -> Column:
    """A ``verdict`` with shown, verified and source, by the functions given: ``restore`` writes the date as the document has it, ``verify`` says whether the document
    carries that, ``locate`` gives its citation. Without them the date stays as it is, is not verified and has no source."""
    shown = restore(found["text"]) if restore else found["text"]
    verified = F.coalesce(verify(shown), F.lit(False)) if verify else F.lit(False)
    source = locate(shown) if locate else F.lit(None).cast("int")
    return found.withField("shown", shown).withField("verified", verified).withField("source", F.when(verified, source) if verify else source)
