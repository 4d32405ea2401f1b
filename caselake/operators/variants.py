"""Answers of unknown or loosely kept shape, as VARIANT: trees as rows, profiles of their paths, view trees as lines, and contracts held to a fixed shape.

A tree is opened level by level inside its row, in one expression of a bounded number of levels: one scan, no shuffle, no Python. VARIANT keeps the members of an object by name, so members come in the order of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import masking as K
from ..functions.text import let
from ..session import spread

#: Levels that are opened, items of a list that are kept, characters of a text.
MOST_LEVELS, MOST_ITEMS, MOST_TEXT = 10, 300, 6000
#: What stands for a text in interface examples (a fixed value).
PLACEHOLDER = "string"
CUT = "…"


def kind(v: Column) -> Column:
    """object, array, string, boolean, null or number; null for no value at all."""

    def word(said: Column) -> Column:
        named = F.when(said.startswith("OBJECT"), "object").when(said.startswith("ARRAY"), "array")
        return named.when(said == "STRING", "string").when(said == "BOOLEAN", "boolean").when(said == "VOID", "null").when(said.isNotNull(), "number")

    return let(F.schema_of_variant(v), word)


def at(v: Column, *keys: str) -> Column:
    """The value under names, one below the other; null where any of them is missing."""
    return F.try_variant_get(v, "$" + "".join(f"['{k}']" for k in keys), "variant") if keys else v


def _said(v: Column) -> Column:
    """struct(said, text): the type of a value and its text; the value is looked up once."""
    return let(v, lambda x: F.struct(F.schema_of_variant(x).alias("said"), F.try_variant_get(x, "$", "string").alias("text")))


def _plain(x: Column) -> Column:
    number = F.when(x["said"].rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.regexp_replace(x["text"], r"\.0+$", "")).otherwise("")
    return F.when(x["said"] == "STRING", F.btrim(x["text"], F.lit(" \t\n\r\x0b\f"))).otherwise(number)


def scalar(v: Column) -> Column:
    """A text (trimmed) or a number as digits without an empty fraction; anything else is the empty text."""
    return let(_said(v), _plain)


def limited(text: Column, most: int = MOST_TEXT) -> Column:
    """A text without placeholders, with a mark where it is cut."""
    return let(text, lambda t: F.when((F.length(t) == len(PLACEHOLDER)) & (F.lower(t) == PLACEHOLDER), "").when(F.length(t) > most, F.concat(F.left(t, F.lit(most)), F.lit(CUT))).otherwise(t))


def items(v: Column, most: int = MOST_ITEMS) -> Column:
    """The first ``most`` items of a list; one object where a list was promised is a list of one. Null without either."""
    listed = F.slice(F.try_variant_get(v, "$", "array<variant>"), 1, most)
    return F.coalesce(listed, F.when(F.schema_of_variant(v).startswith("OBJECT"), F.array(v)))


def objects(v: Column, most: int) -> Column:
    """The objects among the items."""
    return F.filter(F.coalesce(items(v, most), F.array().cast("array<variant>")), lambda x: F.schema_of_variant(x).startswith("OBJECT"))


_NODES = "array<struct<at:array<int>,path:string,parent_path:string,key:string,parent:string,record:string,kind:string,value:variant>>"


def _children(x: Column, most: int) -> Column:
    """The values inside a node, members by name and items in order; no items where it is no container."""

    def node(i: Column, path: Column, key: Column, parent: Column, record: Column, value: Column) -> Column:
        parts = {"at": F.array_append(x["at"], i), "path": path, "parent_path": x["path"], "key": key, "parent": parent, "record": record, "kind": kind(value), "value": value}
        return F.struct(*(c.alias(name) for name, c in parts.items()))

    member = lambda e, i: node(i, F.concat(x["path"], F.when(x["path"] != "", ".").otherwise(""), e["key"]), e["key"], x["key"], x["record"], e["value"])
    item = lambda v, i: node(i, F.concat(x["path"], F.lit("[]")), x["key"], x["parent"], F.concat(x["record"], F.lit("/"), x["key"], F.lit("."), (i + 1).cast("string")), v)
    members = F.transform(F.map_entries(F.try_variant_get(x["value"], "$", "map<string,variant>")), member)
    items = F.transform(F.slice(F.try_variant_get(x["value"], "$", "array<variant>"), 1, most), item)
    return F.when(x["kind"] == "object", members).when(x["kind"] == "array", items).otherwise(F.array().cast(_NODES))


def nodes(df: DataFrame, doc: str, v: str, levels: int = MOST_LEVELS, most: int = MOST_ITEMS, above: bool = True) -> DataFrame:
    """All values of each tree: (doc, at, path, parent_path, key, parent, record, kind, value).

    ``path`` joins names by dots, with ``[]`` for an item of a list, ``at`` is its place, ``parent`` the key above, and ``record`` names the list items that hold a
    value. What lies deeper than ``levels``, and items after the first ``most``, are left out. Without ``above`` only values without children come, empty containers too.
    """
    none = F.array().cast(_NODES)
    top = lambda x: F.array(F.struct(F.array().cast("array<int>").alias("at"), *(F.lit("").alias(c) for c in ("path", "parent_path", "key", "parent", "record")), kind(x).alias("kind"), x.alias("value")))

    def down(acc: Column, _: Column) -> Column:
        def met(opened: Column) -> Column:
            kept = acc["level"] if above else F.transform(F.filter(opened, lambda o: F.size(o["inside"]) == 0), lambda o: o["own"])
            return F.struct(F.concat(acc["out"], kept).alias("out"), F.flatten(F.transform(opened, lambda o: o["inside"])).alias("level"))

        opened = let(F.transform(acc["level"], lambda x: F.struct(x.alias("own"), _children(x, most).alias("inside"))), met)
        return F.when(F.size(acc["level"]) == 0, acc).otherwise(opened)

    tree = F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.struct(none.alias("out"), let(F.col(v), top).alias("level")), down, lambda acc: F.concat(acc["out"], acc["level"]))
    rows = df.where(F.col(v).isNotNull()).select(doc, F.explode(F.array(tree)).alias("nodes"))  # worked out once, as explode asks for a list's size before it opens it
    return rows.select(doc, F.explode("nodes").alias("node")).select(doc, "node.*")


def profile(df: DataFrame, v: str, levels: int = MOST_LEVELS) -> DataFrame:
    """By path, at every depth: how many objects of the path above have it (n) of how many there are (of), and the kinds of its values.

    The top is one value a row; of an item of a list, ``of`` counts the lists.
    """
    found = nodes(df.select(F.lit(0).alias("doc"), v), "doc", v, levels, most=1 << 30)
    ends = F.try_element_at("at", F.lit(-1))
    by = found.groupBy("path", "parent_path").agg(
        F.count("*").alias("times"),
        F.count(F.when(ends == 0, 1)).alias("firsts"),
        F.count(F.when(F.col("kind") == "object", 1)).alias("objects"),
        F.count(F.when(F.col("kind") == "array", 1)).alias("lists"),
        F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"),
    )
    over = by.select(F.col("path").alias("parent_path"), "objects", "lists")
    listed = F.col("path").endswith("[]")
    n = F.when(listed, F.col("firsts")).otherwise(F.col("times"))
    of = F.when(F.col("path") == "", F.col("times")).when(listed, F.col("o.lists")).otherwise(F.col("o.objects"))
    return by.drop("objects", "lists").alias("b").join(over.alias("o"), "parent_path", "left").select("path", n.alias("n"), of.alias("of"), "kinds")


def array_or_null(text: Column, *keys: str) -> Column:
    """The list of texts under names of a JSON text; null where the text is damaged, the value missing or no list."""
    v = at(F.try_parse_json(text), *keys)
    return F.when(kind(v) == "array", F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.try_variant_get(x, "$", "string")))


# View trees as lines.

#: Lines of an answer, items of a list and rows of a table at most; characters of a label or value; what a depth-capped tree says (a fixed value).
MOST_LINES, LINE_ITEMS, LINE_ROWS, MOST_VALUE = 60, 8, 10, 160
DEEPER = "بيانات أعمق لم تُعرض"


def _clip(v: Column) -> Column:
    said = let(_said(v), lambda x: F.coalesce(F.when(x["said"] == "BOOLEAN", F.initcap(x["text"])), _plain(x)))
    return F.left(F.btrim(F.regexp_replace(said, r"(?U)\s+", " ")), F.lit(MOST_VALUE))


_LISTED = "array<variant>"


def _leaf_lines(node: Column, over: Column) -> Column:
    """Lines of a field, a list or a table."""
    none = F.array().cast(_LISTED)
    line = lambda label, value: F.struct(label.alias("label"), value.alias("value"))
    listed = lambda key, most: F.slice(F.coalesce(F.try_variant_get(node, f"$.{key}", _LISTED), none), 1, most)
    of_row = lambda name, columns, cells, i: F.transform(
        F.slice(columns, 1, F.least(F.size(columns), F.size(cells))), lambda c, j: line(F.concat(name, F.lit(" "), (i + 1).cast("string"), F.lit(" - "), c), _clip(F.get(cells, j)))
    )
    rows = lambda name, columns: F.flatten(
        F.transform(listed("rows", LINE_ROWS), lambda r, i: let(F.coalesce(F.try_variant_get(r, "$", _LISTED), none), lambda cells: of_row(name, columns, cells, i)))
    )

    def of(x: Column) -> Column:
        return (
            F.when(x["kind"] == "field", F.array(line(x["name"], _clip(at(node, "value")))))
            .when(x["kind"] == "list", F.array(line(x["name"], F.left(F.array_join(F.transform(listed("items", LINE_ITEMS), _clip), "، "), F.lit(MOST_VALUE)))))
            .when(x["kind"] == "table", let(F.transform(listed("columns", MOST_ITEMS), _clip), lambda columns: rows(x["name"], columns)))
        )

    name = F.concat_ws(" - ", F.nullif(over, F.lit("")), F.nullif(_clip(at(node, "label")), F.lit("")))
    return let(F.struct(scalar(at(node, "type")).alias("kind"), name.alias("name")), of)


def _opened(x: Column) -> Column:
    """What stands for a struct(node, over, leaf) one level down: the children of a group, cards or a list, in order, or a leaf itself."""
    node = x["node"]
    inside = lambda key: F.try_variant_get(node, f"$.{key}", _LISTED)
    held = lambda said: F.coalesce(F.try_variant_get(node, "$", _LISTED), F.when(said == "group", inside("children")).when(said == "cards", F.slice(inside("items"), 1, LINE_ROWS)))
    flat = lambda many: F.flatten(F.transform(many, lambda y: F.coalesce(F.try_variant_get(y, "$", _LISTED), F.array(y))))
    child = lambda y, over, leaf: F.struct(y.alias("node"), over.alias("over"), F.lit(leaf).alias("leaf"))

    def of(k: Column) -> Column:
        label = F.concat_ws(" - ", F.nullif(x["over"], F.lit("")), F.nullif(_clip(at(node, "label")), F.lit("")))
        over = F.when(k["said"] == "group", label).otherwise(x["over"])
        below = let(over, lambda o: F.transform(flat(k["many"]), lambda y: child(y, o, False)))
        none = F.slice(F.array(child(node, x["over"], False)), 1, 0)
        return F.when(k["many"].isNotNull(), below).when(F.coalesce(k["said"].isin("group", "cards"), F.lit(False)), none).otherwise(F.array(child(node, x["over"], True)))

    said = F.try_variant_get(node, "$.type", "string")
    return F.when(x["leaf"], F.array(x)).otherwise(let(let(said, lambda t: F.struct(t.alias("said"), held(t).alias("many"))), of))


def view_lines(df: DataFrame, doc: str, view: str, levels: int = MOST_LEVELS) -> DataFrame:
    """(doc, line, label, value) of view trees (JSON): the first MOST_LINES values of each, in order, with the labels above them in their own.

    A node is a field, a list, a table, or holds others: a group under its label, cards (lists of nodes among them) without one. Damaged JSON has
    no lines; nodes below ``levels`` groups or cards, two more than a view nests, are left out. A tree is walked inside its row, without a shuffle.
    """
    top = let(F.try_parse_json(view), lambda v: F.coalesce(F.try_variant_get(v, "$", _LISTED), F.array(v)))
    rows = spread(df).select(doc, F.transform(top, lambda node: F.struct(node.alias("node"), F.lit("").alias("over"), F.lit(False).alias("leaf"))).alias("found"))
    for _ in range(levels - 1):
        rows = rows.withColumn("found", F.flatten(F.transform("found", _opened)))
    lines = F.flatten(F.filter(F.transform("found", lambda x: _leaf_lines(x["node"], x["over"])), lambda l: l.isNotNull()))  # noqa: E741
    told = F.slice(F.filter(lines, lambda l: (l["value"] != "") & (l["value"] != DEEPER)), 1, MOST_LINES)  # noqa: E741
    rows = rows.select(doc, F.explode(F.array(told)).alias("told"))  # worked out once, as explode asks for a list's size before it opens it
    return rows.select(doc, F.posexplode("told").alias("line", "l")).select(doc, (F.col("line") + 1).alias("line"), "l.label", "l.value")


# Contracts held to a fixed shape.

#: Parties, managers and activities at most; articles of either list at most.
MOST_ENTRIES, MOST_ARTICLES = 200, 300

_IDENTITY = {"id_masked": ("identity.id", "masked"), "id_type": ("identity.typeName", "text", 100)}
#: The shape: output field to (place in the answer, kind[, characters]); a dict under (place, kind, fields) is a list of objects. Names of the answer and of the shape.
CONTRACT = {
    "contract": {"copy_number": ("contractCopyNumber", "plain"), "date": ("contractDate", "text", 40)},
    "entity": {
        "national_number": ("entity.crNationalNumber", "plain"),
        "cr_number": ("entity.crNumber", "plain"),
        "name": ("entity.name", "text", 300),
        "name_language": ("entity.nameLangDesc", "text", 60),
        "entity_type": ("entity.entityType.name", "text", 100),
        "legal_form": ("entity.entityType.formName", "text", 100),
        "characters": ("entity.entityType.characters", "names"),
        "duration": ("entity.companyDuration", "number"),
        "headquarters": ("entity.headquarterCityName", "text", 100),
        "license_based": ("entity.isLicenseBased", "flag"),
        "license_issuer": ("entity.licenseIssuerName", "text", 200),
    },
    "capital": {
        "currency": ("entity.capital.currencyName", "text", 60),
        "contribution": {
            "?": "entity.capital.contributionCapital",
            "type": ("entity.capital.contributionCapital.typeName", "text", 60),
            "cash": ("entity.capital.contributionCapital.cashCapital", "number"),
            "in_kind": ("entity.capital.contributionCapital.inKindCapital", "number"),
            "share_value": ("entity.capital.contributionCapital.contributionValue", "number"),
            "cash_shares": ("entity.capital.contributionCapital.totalCashContribution", "number"),
            "in_kind_shares": ("entity.capital.contributionCapital.totalInKindContribution", "number"),
        },
        "stock": {
            "?": "entity.capital.stockCapital",
            "type": ("entity.capital.stockCapital.typeName", "text", 60),
            "capital": ("entity.capital.stockCapital.capital", "number"),
            "announced": ("entity.capital.stockCapital.announcedCapital", "number"),
            "paid": ("entity.capital.stockCapital.paidCapital", "number"),
            "cash": ("entity.capital.stockCapital.cashCapital", "number"),
            "in_kind": ("entity.capital.stockCapital.inKindCapital", "number"),
            "stocks": ("entity.capital.stockCapital.stocks", MOST_ENTRIES, {"type": ("typeName", "text", 60), "count": ("count", "number"), "value": ("value", "number"), "class": ("className", "text", 100)}, None),
        },
    },
    "fiscal_year": {
        "?": "entity.fiscalYear",
        "first": ("entity.fiscalYear.isFirst", "flag"),
        "calendar": ("entity.fiscalYear.calendarTypeName", "text", 60),
        "end": ("entity.fiscalYear", "day"),
    },
    "parties": (
        "entity.parties",
        MOST_ENTRIES,
        {
            "name": ("name", "text", 300),
            "type": ("typeName", "text", 100),
            **_IDENTITY,
            "nationality": ("nationality.name", "text", 100),
            "roles": ("partnership", "names"),
            "cash_shares": ("partnerShare.cashContributionCount", "number"),
            "in_kind_shares": ("partnerShare.inKindContributionCount", "number"),
            "total_shares": ("partnerShare.totalContributionCount", "number"),
            "profit_pct": ("partnerProfitLossDistribution.profitDistribution", "number"),
            "loss_pct": ("partnerProfitLossDistribution.lossDistribution", "number"),
            "cr_number": ("crNumber", "plain"),
            "license_no": ("licenseNo", "plain"),
            "guardian": {
                "?": "guardian.name",
                "name": ("guardian.name", "text", 300),
                "id_masked": ("guardian.identity.id", "masked"),
                "id_type": ("guardian.identity.typeName", "text", 100),
                "nationality": ("guardian.nationality.name", "text", 100),
                "is_father": ("guardian.isFatherGuardian", "flag"),
            },
        },
        None,
    ),
    "management": {
        "structure": ("entity.management.structureName", "text", 100),
        "dismissal": ("entity.management.dismissalMethod", "free", 1000),
        "managers": (
            "entity.management.managers",
            MOST_ENTRIES,
            {"name": ("name", "text", 300), "type": ("typeName", "text", 100), **_IDENTITY, "nationality": ("nationality.name", "text", 100), "positions": ("positions", "names"), "licensed": ("isLicensed", "flag")},
            None,
        ),
    },
    "activities": ("entity.activities", MOST_ENTRIES, {"code": ("id", "plain"), "name": ("name", "text", 400)}, "name"),
    "notification_channels": ("notificationChannel", "names"),
    "decisions": ("partnerDecision", MOST_ENTRIES, {"name": ("name", "text", 300), "approve_pct": ("approvePercentage", "number"), "note": ("approveAdditionalText", "free", 1000)}, "name"),
    "decisions_note": ("additionalDecisionText", "free", 2000),
    "profit_set_aside": {"?": "setAsideDetails.isSetAsideEnabled", "pct": ("setAsideDetails.profitAllocation.percentage", "number"), "purpose": ("setAsideDetails.profitAllocation.purpose", "free", 500)},
    "articles": ("articles", MOST_ARTICLES, {"part": ("partName", "text", 200), "title": ("", "nothing"), "text": ("text", "free")}, "text"),
    "additional_articles": ("additionalArticles", MOST_ARTICLES, {"part": ("partName", "text", 200), "title": ("title", "free", 300), "text": ("text", "free")}, "text"),
}


def _number(text: Column) -> Column:
    return F.regexp_extract(text, r"^-?[0-9]+(\.[0-9]+)?$", 0)


def _masked(text: Column) -> Column:
    """All but the last four characters hidden; four or fewer hidden altogether."""
    return let(text, lambda t: F.concat(F.repeat(F.lit(K.HIDDEN), F.length(t) - F.greatest(F.lit(0), F.when(F.length(t) > 4, 4).otherwise(0))), F.when(F.length(t) > 4, F.right(t, F.lit(4))).otherwise("")))


def _day(v: Column) -> Column:
    """year/month/day of a fiscal year's end, from the parts that are numbers."""
    year, month, day = (_number(scalar(at(v, k))) for k in ("endYear", "endMonth", "endDay"))
    two = lambda t: F.when(t != "", F.when(F.length(t) < 2, F.lpad(t, 2, "0")).otherwise(t))
    return F.concat_ws("/", F.nullif(year, F.lit("")), two(month), two(day))


def shaped_field(found: Column, how: str, most: int = MOST_TEXT) -> Column:
    """A value of an answer: plain (digits or text as it stands), text (cut), free (long numbers hidden, then cut), number, flag, masked, names or day.

    Most fields of a shape are missing in most answers; what no value gives is said without a look at it.
    """
    some = lambda c: F.when(found.isNull(), "").otherwise(c)
    name = lambda x: limited(scalar(F.try_variant_get(x, "$", "struct<name:variant>")["name"]), 300)
    return {
        "nothing": lambda: F.lit(""),
        "plain": lambda: some(scalar(found)),
        "text": lambda: some(limited(scalar(found), most)),
        "free": lambda: some(limited(K.long_numbers(scalar(found)), most)),
        "number": lambda: some(_number(scalar(found))),
        "flag": lambda: F.when(found.isNotNull() & (kind(found) == "boolean"), F.try_variant_get(found, "$", "boolean")),
        "masked": lambda: some(_masked(scalar(found))),
        "names": lambda: F.when(found.isNull(), F.array().cast("array<string>")).otherwise(F.filter(F.transform(objects(found, MOST_ENTRIES), name), lambda n: n != "")),
        "day": lambda: some(_day(found)),
    }[how]()


def _there(found: Column) -> Column:
    """Whether a part of the shape is filled: an object with members, a text, or true."""
    filled = lambda x: ((x["said"].startswith("OBJECT")) & (x["said"] != "OBJECT<>")) | (~F.lower(x["text"]).isin("", PLACEHOLDER)) | (x["said"].eqNullSafe("BOOLEAN") & x["flag"].eqNullSafe(True))
    known = let(F.struct(F.coalesce(F.schema_of_variant(found), F.lit("")).alias("said"), scalar(found).alias("text"), F.try_variant_get(found, "$", "boolean").alias("flag")), filled)
    return F.when(found.isNull(), False).otherwise(F.coalesce(known, F.lit(False)))


def _places(shape: dict) -> dict:
    """The places that a shape names, as a tree of names; those inside lists are places of an item."""
    tree: dict = {}
    for name, rule in shape.items():
        below = _places(rule) if isinstance(rule, dict) else {}
        place = rule if name == "?" else "" if isinstance(rule, dict) else rule[0]
        for key in reversed(place.split(".") if place else []):
            below = {key: below}
        _grow(tree, below)
    return tree


def _grow(tree: dict, other: dict) -> None:
    for key, below in other.items():
        _grow(tree.setdefault(key, {}), below)


def _laid_out(v: Column, tree: dict) -> Column:
    """The values at a tree of places, each struct(it, below): an object is opened once for all names that are looked for in it, there or not."""

    def members(row: Column) -> Column:
        return F.struct(*(F.struct(row[key].alias("it"), *([_laid_out(row[key], below).alias("below")] if below else [])).alias(key) for key, below in tree.items()))

    return let(F.try_variant_get(v, "$", "struct<" + ",".join(f"`{key}`:variant" for key in tree) + ">"), members)


def _found(laid: Column, place: str) -> Column:
    *above, last = place.split(".")
    for key in above:
        laid = laid[key]["below"]
    return laid[last]["it"]


def _shaper(shape: dict):
    return lambda x: shaped(x, shape)


def _filled(name: str):
    return lambda x: x.getField(name) != ""


def _fields(laid: Column, shape: dict) -> Column:
    fields = []
    for name, rule in shape.items():
        if name == "?":
            continue
        if isinstance(rule, dict):
            part = _fields(laid, rule)
            fields.append((F.when(_there(_found(laid, rule["?"])), part) if "?" in rule else part).alias(name))
        elif isinstance(rule[1], int):
            place, most, inner, needed = rule
            entries = F.transform(objects(_found(laid, place), most), _shaper(inner))
            fields.append((F.filter(entries, _filled(needed)) if needed else entries).alias(name))
        else:
            place, *how = rule
            fields.append(shaped_field(_found(laid, place) if place else F.lit(None), *how).alias(name))
    return F.struct(*fields)


def shaped(v: Column, shape: dict) -> Column:
    """A VARIANT as a struct of the stated fields. A part marked by ``?`` is null unless the place named there is filled."""
    return let(_laid_out(v, _places(shape)), lambda laid: _fields(laid, shape))


def contracts(df: DataFrame, answer: str, into: str = "contract") -> DataFrame:
    """``df`` with a register's contract answer (JSON) in the shape of CONTRACT; null if it is damaged or names no entity."""
    parsed = df.withColumn("__parsed", F.try_parse_json(answer))
    return parsed.withColumn(into, F.when(let(at(F.col("__parsed"), "entity"), _there), shaped(F.col("__parsed"), CONTRACT))).drop("__parsed")
