"""Declared registries: compiled fields and each rule that rejects one."""

import copy

import pytest

from caselake.operators import registry

DECLARED = {
    "value_types": {"name": None, "deed": {"fallback": ["name"]}, "enum": {}},
    "field_groups": {
        "person": {"section": "Parties", "instantiable": True, "fields": [{"key": "name", "label_ar": "الاسم", "type": "name", "aliases_ar": ["اسم"]}, {"key": "id", "label_ar": "رقم الهوية", "type": "deed"}]},
        "deed": {"section": "Deed", "repeatable": True, "fields": [{"key": "number", "label_ar": "الرقم", "type": "deed"}]},
    },
    "templates": [
        {
            "id": "sale",
            "sections": ["Parties", "Deed"],
            "groups": [{"use": "person", "instances": [{"prefix": "seller", "role": "seller", "label_ar": "البائع", "require": ["name"]}, {"prefix": "buyer", "role": "buyer", "label_ar": "المشتري", "section": "deed"}]}, {"use": "deed", "require": "number"}],
            "fields": [{"key": "kind", "label_ar": "النوع", "type": "enum", "enum_values_ar": ["a", "b"], "section": "Deed"}],
            "anchors": [{"text": "عقد بيع", "in_section": "Deed"}],
        }
    ],
}


def test_fields_of_groups_roles_and_own(spark):
    got = {r["key"]: r for r in registry.checked(registry.relations(spark, DECLARED)).collect()}
    assert sorted(got) == ["buyer_id", "buyer_name", "kind", "number", "seller_id", "seller_name"]
    seller = got["seller_name"]
    assert (seller["label"], seller["section"], seller["required"], seller["role"], seller["source"]) == ("اسم البائع", "Parties", True, "seller", "person")
    assert seller["aliases"] == ["اسم البائع"] and seller["shared_aliases"] == ["الاسم", "اسم"]
    assert got["buyer_id"]["section"] == "deed" and not got["buyer_name"]["required"] and got["buyer_id"]["label"] == "رقم هوية المشتري"
    assert got["number"]["required"] and got["number"]["repeatable"] and got["kind"]["choices"] == ["a", "b"] and got["kind"]["source"] == "local"


def change(path, value):
    d = copy.deepcopy(DECLARED)
    at = d
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    return d


TEMPLATE = ("templates", 0)


@pytest.mark.parametrize(
    ("declared", "rule"),
    [
        (change((*TEMPLATE, "groups", 1, "use"), "none"), "unknown group"),
        (change(("field_groups", "person", "instantiable"), False), "group without roles"),
        (change((*TEMPLATE, "groups", 0, "instances", 0, "prefix"), ""), "role without a prefix"),
        (change((*TEMPLATE, "groups", 1, "require"), ["nothing"]), "unknown required field"),
        (change((*TEMPLATE, "fields", 0, "key"), "number"), "key twice"),
        (change((*TEMPLATE, "fields", 0, "key"), None), "field without key or type"),
        (change((*TEMPLATE, "fields", 0, "type"), "colour"), "unknown type"),
        (change(("value_types", "deed"), {"fallback": "colour"}), "unknown fallback"),
        (change((*TEMPLATE, "fields", 0, "enum_values_ar"), []), "enum without choices"),
        (change((*TEMPLATE, "anchors", 0, "in_section"), ["Elsewhere"]), "anchor in an unknown section"),
    ],
)
def test_each_rule_rejects(spark, declared, rule):
    r = registry.relations(spark, declared)
    assert rule in {x["rule"] for x in registry.findings(r).where("level = 'error'").collect()}
    with pytest.raises(ValueError, match=rule):
        registry.checked(r)


def test_a_field_in_an_unknown_section_is_a_warning(spark):
    r = registry.relations(spark, change((*TEMPLATE, "fields", 0, "section"), "Elsewhere"))
    assert [(x["level"], x["rule"]) for x in registry.findings(r).collect()] == [("warning", "field in an unknown section")] and registry.checked(r).count() == 6
