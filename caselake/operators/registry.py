"""A declared registry of templates: groups of fields used by templates, once or in several roles, compiled to one row a field, with every cross-reference checked.

The registry comes as relations (read from a file by ``relations``, or tables of the same columns): groups (grp, section, repeatable, instantiable),
group_fields (grp, at, key, label, type, aliases, choices), uses (template, at, grp, section, prefix, role, role_label, instance, required), fields (template, at, key, label,
type, section, required, repeatable, aliases, choices), sections (template, section), types (type, fallback) and anchors (template, anchor, in_section).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import small
from .answers import role_label

SCHEMAS = {
    "groups": "grp string, section string, repeatable boolean, instantiable boolean",
    "group_fields": "grp string, at int, key string, label string, type string, aliases array<string>, choices array<string>",
    "uses": "template string, at int, grp string, section string, prefix string, role string, role_label string, instance boolean, required array<string>",
    "fields": "template string, at int, key string, label string, type string, section string, required boolean, repeatable boolean, aliases array<string>, choices array<string>",
    "sections": "template string, section string",
    "types": "type string, fallback array<string>",
    "anchors": "template string, anchor string, in_section array<string>",
}


def relations(spark: SparkSession, declared: dict) -> dict[str, DataFrame]:
    """The relations of a registry as a YAML or JSON file declares it: ``field_groups``, ``value_types`` and ``templates``."""
    rows: dict[str, list[tuple]] = {k: [] for k in SCHEMAS}
    texts = lambda v: [str(x) for x in ([v] if isinstance(v, str) else v or [])]
    field = lambda f: (f.get("key"), str(f.get("label_ar", "")), f.get("type"), texts(f.get("aliases_ar")), texts(f.get("enum_values_ar")))
    for name, g in (declared.get("field_groups") or {}).items():
        rows["groups"].append((name, g.get("section"), bool(g.get("repeatable", False)), bool(g.get("instantiable", False))))
        rows["group_fields"] += [(name, i, *field(f)) for i, f in enumerate(g.get("fields") or [])]
    rows["types"] = [(name, texts((t or {}).get("fallback"))) for name, t in (declared.get("value_types") or {}).items()]
    for t in declared.get("templates") or []:
        name = t["id"]
        at = 0
        for use in t.get("groups") or []:
            roles = use.get("instances") or [None]
            for role in roles:
                own = role or use
                rows["uses"].append((name, at, use.get("use"), own.get("section"), own.get("prefix") if role else None, own.get("role") if role else None, own.get("label_ar") if role else None, bool(role), texts(own.get("require"))))
                at += 1
        for i, f in enumerate(t.get("fields") or []):
            key, label, kind, aliases, choices = field(f)
            rows["fields"].append((name, i, key, label, kind, str(f.get("section", "")), bool(f.get("required", False)), bool(f.get("repeatable", False)), aliases, choices))
        rows["sections"] += [(name, x) for x in texts(t.get("sections"))]
        rows["anchors"] += [(name, str(a.get("text", "")), texts(a.get("in_section"))) for a in t.get("anchors") or [] if isinstance(a, dict)]
    return {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in rows.items()}


def compiled(r: dict[str, DataFrame]) -> DataFrame:
    """Every field of every template: (template, place, key, label, type, section, required, repeatable, role, source, aliases, shared_aliases, choices).

    A role's field has the role's prefix in its key and the role in its label; its own label and aliases are shared with the other roles' then. A use of a
    group names its own section or takes the group's.
    """
    used = r["uses"].join(small(r["groups"].select("grp", F.col("section").alias("__section"), "repeatable", "instantiable")), "grp").join(small(r["group_fields"].withColumnRenamed("at", "no")), "grp")
    role = F.coalesce("role_label", F.lit("")) != ""
    composed = F.when(role, role_label(F.col("label"), F.col("role_label"))).otherwise(F.col("label"))
    none = F.array().cast("array<string>")
    of_groups = used.select(
        "template", F.struct(F.lit(0).alias("local"), "at", "no").alias("place"), F.concat_ws("_", "prefix", "key").alias("key"), composed.alias("label"), "type", F.coalesce("section", "__section", F.lit("")).alias("section"),
        F.coalesce(F.array_contains("required", F.col("key")), F.lit(False)).alias("required"), "repeatable", "role", F.col("grp").alias("source"), F.when(role, F.array(composed)).otherwise(F.col("aliases")).alias("aliases"),
        F.when(role, F.concat(F.array("label"), "aliases")).otherwise(none).alias("shared_aliases"), "choices",
    )
    local = r["fields"].select(
        "template", F.struct(F.lit(1).alias("local"), "at", F.lit(0).alias("no")).alias("place"), "key", "label", "type", F.coalesce("section", F.lit("")).alias("section"), "required", "repeatable", F.lit(None).cast("string").alias("role"),
        F.lit("local").alias("source"), "aliases", none.alias("shared_aliases"), "choices",
    )
    return of_groups.unionByName(local)


def findings(r: dict[str, DataFrame]) -> DataFrame:
    """What is wrong with a registry: (level, template, rule, detail). Each rule is an anti-join or a count; a registry may be used if it has no ``error``."""
    fields = compiled(r)

    def found(df: DataFrame, rule: str, detail: Column, level: str = "error") -> DataFrame:
        return df.select(F.lit(level).alias("level"), "template", F.lit(rule).alias("rule"), detail.alias("detail"))

    uses, groups = r["uses"], small(r["groups"].select("grp", "instantiable"))
    asked = uses.select("template", "grp", F.explode("required").alias("key"))
    sections = r["sections"].select("template", X.fold(F.col("section")).alias("folded")).distinct()
    types = small(r["types"].select("type", "fallback"))
    typed = fields.join(types, "type", "left")
    fallbacks = typed.select("template", "key", F.explode("fallback").alias("other")).join(types.select(F.col("type").alias("other")), "other", "left_anti")
    gated = r["anchors"].select("template", "anchor", F.explode("in_section").alias("section")).withColumn("folded", X.fold(F.col("section")))
    placed = fields.where("section != ''").withColumn("folded", X.fold(F.col("section")))
    checks = [
        found(uses.join(groups, "grp", "left_anti"), "unknown group", F.coalesce("grp", F.lit(""))),
        found(uses.join(groups, "grp").where("instance and not instantiable"), "group without roles", F.col("grp")),
        found(uses.where("instance and coalesce(prefix, '') = ''"), "role without a prefix", F.coalesce("role", "grp")),
        found(asked.join(groups, "grp", "left_semi").join(small(r["group_fields"].select("grp", "key")), ["grp", "key"], "left_anti"), "unknown required field", F.concat_ws(".", "grp", "key")),
        found(fields.where("coalesce(key, '') = '' or coalesce(type, '') = ''"), "field without key or type", F.concat_ws(".", "source", "key")),
        found(fields.groupBy("template", "key").count().where("count > 1"), "key twice", F.col("key")),
        found(fields.join(types, "type", "left_anti").where("type != ''"), "unknown type", F.concat_ws(": ", "key", "type")),
        found(fallbacks, "unknown fallback", F.concat_ws(": ", "key", "other")),
        found(fields.where("type = 'enum' and size(choices) = 0"), "enum without choices", F.col("key")),
        found(gated.join(sections, ["template", "folded"], "left_anti"), "anchor in an unknown section", F.concat_ws(": ", "anchor", "section")),
        found(placed.join(sections, ["template", "folded"], "left_anti"), "field in an unknown section", F.concat_ws(": ", "key", "section"), "warning"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def checked(r: dict[str, DataFrame]) -> DataFrame:
    """The compiled fields, or an error that names up to ten findings."""
    if bad := findings(r).where("level = 'error'").limit(10).collect():
        raise ValueError("; ".join(f"{x['template']}: {x['rule']} ({x['detail']})" for x in bad))
    return compiled(r)
